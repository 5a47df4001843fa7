import numpy as np
import pytest
from pyspark.sql import functions as F

from triagework.models.cells import CellForest, drawn_weights, fit_cell_forest, grow_tree


def plain_tree(rows, weights, y, depth, min_rows):
    """Prediction of every row by trying all one-value splits on the weighted rows themselves."""
    out = np.zeros(len(rows))

    def error(at):
        w = weights[at].sum()
        return (weights[at] * y[at] ** 2).sum() - (weights[at] * y[at]).sum() ** 2 / w if w else 0.0

    def grow(at, left):
        best = None
        for column in range(rows.shape[1]):
            for value in sorted(set(rows[:, column])):
                hit = rows[at, column] == value
                sides = at[hit], at[~hit]
                if not left or min(weights[s].sum() for s in sides) < min_rows:
                    continue
                gain = error(at) - error(sides[0]) - error(sides[1])
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = gain, *sides
        if best is None:
            w = weights[at].sum()
            out[at] = (weights[at] * y[at]).sum() / w if w else 0.0
            return
        grow(best[1], left - 1)
        grow(best[2], left - 1)

    grow(np.arange(len(rows)), depth)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = []
    for i in range(300):
        a, b = int(rng.integers(4)), int(rng.integers(3))
        data.append((i, f"v{a}", f"w{b}", None, float(np.round(10 * a + 5 * (b == 1) * a + rng.random() * 3, 3))))
    return spark.createDataFrame(data, "k int, a string, b string, cell string, y double")


def test_poisson_draws():
    weights = drawn_weights(np.arange(20_000), 3, 42)
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.04
    assert abs(np.corrcoef(weights[:, 0], weights[:, 1])[0, 1]) < 0.03


@pytest.mark.parametrize("depth, min_rows", [(3, 5), (12, 1), (0, 5)])
def test_forest_equals_brute_force(rows, depth, min_rows):
    forest = fit_cell_forest(rows, "k", ["a", "b"], "y", trees=6, depth=depth, min_rows=min_rows, seed=7)
    got = rows.select("k", "a", "b", "y", F.xxhash64("k").alias("h")).orderBy("k").collect()
    table = np.array([(int(r.a[1]), int(r.b[1])) for r in got])
    y, keys = np.array([r.y for r in got]), np.array([r.h for r in got])
    weights = drawn_weights(keys, 6, 7)
    want = np.mean([plain_tree(table, weights[:, t], y, depth, min_rows) for t in range(6)], axis=0)
    predicted = {r.k: r.predicted_raw for r in forest.transform(rows).collect()}
    assert [predicted[r.k] for r in got] == pytest.approx(want.tolist())


def test_partitions_do_not_matter(rows):
    one, other = (fit_cell_forest(r, "k", ["a", "b"], "y", trees=4) for r in (rows.coalesce(1), rows.repartition(7)))
    for name in ("nodes", "means", "starts", "categories"):
        assert one.getOrDefault(name) == other.getOrDefault(name)


def test_saved_forest_and_unseen_values(spark, rows, tmp_path):
    forest = fit_cell_forest(rows, "k", ["a", "b"], "y", trees=5)
    forest.write().overwrite().save(str(tmp_path / "forest"))
    loaded = CellForest.load(str(tmp_path / "forest"))
    odd = spark.createDataFrame([("v0", "w0"), ("new", "w1"), (None, None)], "a string, b string")
    got, want = (m.transform(odd).collect() for m in (loaded, forest))
    assert got == want and all(0 < r.predicted_raw < 60 for r in got)


def test_no_rows(rows):
    forest = fit_cell_forest(rows.limit(0), "k", ["a", "b"], "y", trees=5)
    assert {r.predicted_raw for r in forest.transform(rows).collect()} == {0.0}


def test_single_cell_is_a_leaf():
    assert grow_tree(np.array([[0, 0]]), np.array([[9.0, 18000.0, 36e6]]), [1, 1], 5, 1) == [(-1, 0, 0, 0, 2.0)]
