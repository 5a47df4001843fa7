import random

import pytest

from triagework.operators import ranks
from triagework.operators.range_store import append_history, compact_history, stored_counts, stored_ranges
from triagework.operators.ranges import resolution_ranges

SCHEMA = "Priority_Level string, Issue_Category string, Resolution_Time_Hours double"


def history(spark, seed, n=300):
    rng = random.Random(seed)
    rows = [
        (rng.choice(["High", "Low", None]), rng.choice(["Billing", "Fraud", None]), rng.choice([None, float("nan"), 3.0, *range(40)]))
        for _ in range(n)
    ]
    rows = [(p, c, None if h is None else float(h)) for p, c, h in rows]
    return spark.createDataFrame(rows + [("High", "Billing", 7.5)] * n, SCHEMA)


def same(a, b):
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert order(a) == order(b)


@pytest.mark.parametrize("sorted_rows", [200_000, 20])
def test_every_append_equals_a_full_run(spark, tmp_path, monkeypatch, sorted_rows):
    monkeypatch.setattr(ranks, "SORTED_ROWS", sorted_rows)
    path, so_far = str(tmp_path / "store"), None
    assert stored_ranges(spark, path).count() == 0
    for part in range(3):
        new = history(spark, part)
        assert append_history(new, path, f"part {part}") and not append_history(new, path, f"part {part}")
        so_far = new if so_far is None else so_far.unionByName(new)
        same(stored_ranges(spark, path), resolution_ranges(so_far))
    before = stored_counts(spark, path).count()
    assert len(compact_history(spark, path, "all")) == 3 and stored_counts(spark, path).count() < before
    assert compact_history(spark, path, "all") == [] and not append_history(history(spark, 1), path, "part 1")
    same(stored_ranges(spark, path), resolution_ranges(so_far))


def test_an_empty_part(spark, tmp_path):
    path = str(tmp_path / "store")
    assert append_history(history(spark, 0).limit(0), path, "none")
    assert stored_ranges(spark, path).count() == 0
