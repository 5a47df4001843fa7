import zlib
from collections import Counter, defaultdict

import pytest

from triagework.llm.sharding import sharded


def check(rows, texts, shards):
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes = Counter(r.shard for r in rows)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert set(sizes) <= set(range(shards)) and max(counts) - min(counts) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    homes = defaultdict(set)
    for r in rows:
        homes[texts[r.doc_id] or ""].add(r.shard)
    return homes


@pytest.mark.parametrize("shards", [4, 24])
def test_equal_texts_meet_and_counts_stay_even(spark, shards):
    texts = {i: f"text {i % 900 if i < 1500 else i}" for i in range(3001)}
    texts |= {5: None, 6: "", 7: "é" * 50_000, 8: "é" * 50_000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "0 as shard", "1 as row")
    homes = check(sharded(docs.repartition(5), shards).collect(), texts, shards)
    assert all(len(s) == 1 for s in homes.values())


def test_a_hot_text_fills_as_few_shards_as_it_can(spark):
    texts = {i: "hot" if i % 3 == 0 else f"t{i // 2}" for i in range(2400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    homes = check(sharded(docs, 24).collect(), texts, 24)
    assert len(homes["hot"]) <= 10
    others = [len(s) for t, s in homes.items() if t != "hot"]
    assert sum(n > 1 for n in others) <= 0.02 * len(others)


def test_few_rows_and_none(spark):
    texts = {1: "a", 2: "a", 3: "b"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(sharded(docs, 24).collect(), texts, 24)
    assert sharded(docs.limit(0), 24).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    got = sharded(docs, 2).collect()
    assert len(got) == 4 and Counter(r.shard for r in got) == {0: 2, 1: 2}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(i, f"t{i // 2}") for i in range(50)], "doc_id long, text string")
    plan = sharded(docs, 4)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("sizes, forced", [([2] * 1500, 0), ([20] * 150, 6), ([200] * 15, 3), ([20] * 100 + [2] * 500, 0)])
def test_groups_without_single_rows_meet(spark, sizes, forced):
    """Twelve shards hold 250 rows each; a group is split only where no shard has room for it."""
    texts, number = {}, 0
    for group, size in enumerate(sizes):
        for _ in range(size):
            texts[(number := number + 1) * 7919 % 3001] = f"group {group}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = sharded(docs, 12).collect()
    homes = check(rows, texts, 12)
    assert sum(len(s) > 1 for s in homes.values()) <= forced
    assert all(r.link_shards == len(homes[texts[r.doc_id]]) for r in rows)


def test_groups_larger_than_a_shard(spark):
    texts = {i: f"g{i % 3}" for i in range(1000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    homes = check(sharded(docs, 10).collect(), texts, 10)
    assert all(len(s) <= 5 for s in homes.values())
