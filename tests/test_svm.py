import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from triagework.models import svm
from triagework.models.svm import LinearScores, fit_machines

COSTS = [1.4, 0.7, 2.0]


def table(n=150, width=7, seed=3):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < 0.5, rng.normal(size=(n, width)), 0.0)
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(int) + (x[:, 2] > 0.5)
    return x, y


def dense_solve(x, y, costs, other=1.0):
    """Weights by undamped Newton steps on the full matrices, until nothing moves."""
    x = np.hstack([x, np.ones((len(x), 1))])
    out = []
    for c, cost in enumerate(costs):
        sign, weight = np.where(y == c, 1.0, -1.0), np.where(y == c, cost, other)
        w = np.zeros(x.shape[1])
        for _ in range(200):
            short = np.maximum(1 - sign * (x @ w), 0)
            gradient = w - 2 * x.T @ (weight * sign * short)
            active = x[short > 0]
            step = np.linalg.solve(np.eye(len(w)) + 2 * active.T @ (weight[short > 0, None] * active), gradient)
            scale = 1.0
            value = lambda v, s=sign, k=weight: v @ v / 2 + (k * np.maximum(1 - s * (x @ v), 0) ** 2).sum()
            while value(w - scale * step) > value(w) and scale > 1e-9:
                scale /= 2
            w = w - scale * step
            if np.abs(step).max() < 1e-12:
                break
        out.append(w)
    return np.array(out).T


@pytest.fixture(scope="module")
def rows(spark):
    x, y = table()
    data = [
        (int(c), Vectors.dense(v) if i % 5 == 0 else Vectors.sparse(7, [(j, a) for j, a in enumerate(v) if a]))
        for i, (v, c) in enumerate(zip(x, y, strict=True))
    ]
    return spark.createDataFrame([*data, (None, Vectors.dense(np.ones(7)))], ["y", "features"])


@pytest.mark.parametrize("block_rows", [16_384, 40])
def test_equals_a_dense_solve(rows, monkeypatch, block_rows):
    monkeypatch.setattr(svm, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(svm, "ENTRIES_AT_ONCE", 50)
    found = fit_machines(rows, F.col("y"), COSTS, 7, tolerance=1e-9)
    assert found == pytest.approx(dense_solve(*table(), COSTS), abs=1e-6)


def test_scores_are_margins_and_survive_saving(rows, tmp_path):
    found = fit_machines(rows, F.col("y"), COSTS, 7)
    stage = LinearScores(inputCol="features", outputCol="s", labels=["a", "b", "c"], weights=found.ravel().tolist())
    stage.write().overwrite().save(str(tmp_path / "machines"))
    scored = LinearScores.load(str(tmp_path / "machines")).transform(rows).collect()
    hits = 0
    for r in scored:
        want = r.features.toArray() @ found[:-1] + found[-1]
        assert r.s == pytest.approx(want.tolist()) and r.predicted_label == "abc"[int(want.argmax())]
        hits += r.prediction == r.y
    assert hits > 0.8 * len(scored)


def test_empty_vectors_and_no_rows(spark, rows):
    assert not fit_machines(rows.limit(0), F.col("y"), COSTS, 7).any()
    empty = spark.createDataFrame([(0, Vectors.sparse(7, [])), (1, Vectors.sparse(7, []))], ["y", "features"])
    found = fit_machines(empty, F.col("y"), [1.0, 1.0], 7)
    assert found == pytest.approx(dense_solve(np.zeros((2, 7)), np.array([0, 1]), [1.0, 1.0]), abs=1e-6)


def test_many_blocks_take_no_job_per_pass(spark, rows, monkeypatch):
    """Also with all entries in files."""
    monkeypatch.setattr(svm, "BLOCK_ROWS", 40)
    monkeypatch.setattr(svm, "HELD_ENTRIES", 0)
    context = spark.sparkContext
    context.setJobGroup("passes", "machines over many blocks")
    try:
        found = fit_machines(rows, F.col("y"), COSTS, 7, tolerance=1e-9)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert found == pytest.approx(dense_solve(*table(), COSTS), abs=1e-6)
    assert len(context.statusTracker().getJobIdsForGroup("passes")) < 10


def test_classes_that_are_there_are_not_multiplied_again(monkeypatch):
    """Zero columns are skipped, and a class whose direction is close enough is a zero column from then on."""
    x, y = table()
    row, feature = np.nonzero(x)
    rows = svm.Rows(y.astype(np.int32), np.cumsum((x != 0).sum(axis=1)), feature.astype(np.int32), x[row, feature])
    problem, seen = svm.Problem(np.array(COSTS), 1.0, 7), []

    def add(name, both):
        if name == "curved":
            seen.append(np.split(both, 2, axis=1)[1].any(axis=0))
        return getattr(problem, name)(rows, both)

    found, passes = svm.minimise(add, (8, 3), 1e-9, 100)
    assert found == pytest.approx(dense_solve(x, y, COSTS), abs=1e-6) and passes < 200
    assert any(moving.any() and not moving.all() for moving in seen)
    monkeypatch.setattr(svm, "ENTRIES_AT_ONCE", 16)
    factors = np.random.default_rng(2).normal(size=(7, 3)) * [1, 0, 1]
    ends = np.array([0, 3, 3, *rows.ends[5:].tolist()])
    plain = [(x[row, feature][a:b, None] * factors[feature[a:b]]).sum(axis=0) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert svm.group_sums(ends, rows.features, rows.values, factors) == pytest.approx(np.array(plain))
