import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from triagework.llm import hard_negatives
from triagework.llm.hard_negatives import OP13_SQL, cells_by_bound, fit_codes, mine_negatives, op13_hard_negatives, quantised


def brute(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    """All rows against all rows."""
    usable = [r for r in rows if None not in r[:3] and None not in r[2]]
    width = max((len(v) for _, _, v in usable), default=0)
    usable = [(i, label, np.array(v + [0] * (width - len(v)), np.int64)) for i, label, v in usable]
    out = []
    for a, label, x in usable:
        if not is_anchor(a):
            continue
        scored = [(-int(x @ y), i, other) for i, other, y in usable]
        near = sorted((s, i) for s, i, other in scored if other == label and i != a)[:positives]
        for s, p in near:
            fit = sorted((t, i) for t, i, other in scored if other != label and -low * s <= -100 * t <= -high * s)
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fit[:negatives])]
    return sorted(out)


def mined(spark, rows, every=10, **options):
    schema = "vec_id long, label int, vector array<int>, row int, bucket string, cell string"
    table = spark.createDataFrame([(*r, 1, "b", "c") for r in rows], schema)
    return sorted(map(tuple, mine_negatives(table, F.col("vec_id") % every == 0, **options).collect()))


def clustered(rng, n, width=6, groups=4):
    centres = [[rng.randint(-40, 40) for _ in range(width)] for _ in range(groups)]
    return [
        (i, rng.randrange(3), [c + rng.randint(-9, 9) for c in rng.choice(centres)]) for i in range(n)
    ]


def test_heap_gives_every_pair_by_falling_sum():
    rng = np.random.default_rng(1)
    for a, b in ((5, 9), (1, 1), (7, 2), (0, 3)):
        first, second = rng.integers(0, 6, a).astype(float), rng.random(b)
        got = list(cells_by_bound(first, second))
        assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(a) for j in range(b)]
        sums = [s for s, _, _ in got]
        assert sums == sorted(sums, reverse=True)
        assert all(s == first[i] + second[j] for s, i, j in got)


def test_centres_of_few_points_are_the_points():
    points = np.array([[1.0, 2], [1, 2], [3, 4]])
    assert fit_codes(points, 5).tolist() == [[1, 2], [3, 4]]
    assert len(fit_codes(np.random.default_rng(0).random((200, 4)), 7)) == 7


@pytest.mark.parametrize("first_rows", [1, 50])
def test_equals_brute_force(spark, monkeypatch, first_rows):
    monkeypatch.setattr(hard_negatives, "ROWS_PER_CELL", 10)
    monkeypatch.setattr(hard_negatives, "QUERIES_PER_COPY", 3)
    rows = clustered(random.Random(first_rows), 400)
    assert mined(spark, rows, first_rows=first_rows) == brute(rows, lambda i: i % 10 == 0)


def test_few_cells_are_visited(spark, monkeypatch):
    """Bounds keep far groups out."""
    monkeypatch.setattr(hard_negatives, "ROWS_PER_CELL", 5)
    rows = [(i, i % 2, [1000 + i % 7 if d == i % 8 else 0 for d in range(8)]) for i in range(800)]
    visited = []
    plain = hard_negatives.requests

    def counted(*arguments):
        asked = plain(*arguments)
        visited.append(asked.select(F.sum(F.size("cells"))).first()[0] or 0)
        return asked

    monkeypatch.setattr(hard_negatives, "requests", counted)
    got = mined(spark, rows, 100, first_rows=1)
    assert got == brute(rows, lambda i: i % 100 == 0)
    assert sum(visited) < 8 * 60


def test_copies_ties_and_other_windows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKETS", 5)
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [5, 5, 5, 5] if i % 3 else [rng.randint(-6, 6) for _ in range(4)]) for i in range(300)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    options = {"positives": 2, "negatives": 7, "low": 33, "high": 120}
    assert mined(spark, rows, **options) == brute(rows, lambda i: i % 10 == 0, **options)


def test_odd_rows(spark):
    rows = [
        (0, 1, [3, -1]), (1, 1, [2, 2]), (2, 1, [5]), (3, 2, [2, 1]), (4, None, [9, 9]), (5, 2, None), (6, 2, [1, None]),
        (7, 2, []), (None, 2, [3, 3]), (8, 2, [-4, 2]), (3, 2, [2, 1]), (10, 3, [0, 0]), (20, 1, [-3, 1]), (9, 1, [2, 2]),
    ]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows[:0]) == [] and mined(spark, [(0, 1, [2])]) == []
    assert mined(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]) == [(0, 1, 1, 2, 0, 0)]


def test_large_components_stay_exact(spark):
    rng = random.Random(8)
    rows = [(i, i % 2, [rng.randint(-(1 << 29), 1 << 29) for _ in range(3)]) for i in range(60)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_quantised(spark):
    rows = [
        (7, 9, [0.1, -0.1]), (1, 9, [0.5, float("nan")]), (2, None, [0.5]), (3, 4, [None, 0.5]), (4, 4, [float("inf")]),
        (5, 4, [1.0, -1.0]), (6, 4, None),
    ]
    got = quantised(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert [tuple(r) for r in got] == [(7, 0, [25, -26]), (5, 4, [256, -256])]


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    connection.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = sorted(connection.execute(OP13_SQL).fetchall())
    assert want and sorted(map(tuple, op13_hard_negatives(spark, folder).collect())) == want
