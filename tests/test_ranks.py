import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from triagework.operators import ranks, splits


def skewed(rows=6000, seed=3):
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(rows) < 0.4, "hot", rng.choice(["a", "b", "c"], rows))
    value = np.where(rng.random(rows) < 0.3, 7.0, rng.normal(10, 40, rows).round(2))
    frame = pd.DataFrame({"g": group, "h": rng.choice(["x", "y"], rows), "v": value})
    frame.loc[::50, "v"] = np.nan
    frame.loc[::37, "g"] = None
    return frame


@pytest.fixture(scope="module")
def frame():
    return skewed()


@pytest.fixture(scope="module")
def table(spark, frame):
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "g string, h string, v double").repartition(7)


@pytest.mark.parametrize("bits, rows", [(ranks.BUCKET_BITS, ranks.SORTED_ROWS), (0, 10**6), (0, 200)])
def test_quantiles_equal_numpy(table, frame, monkeypatch, bits, rows):
    monkeypatch.setattr(ranks, "BUCKET_BITS", bits)
    monkeypatch.setattr(ranks, "SORTED_ROWS", rows)
    quantiles = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    found = ranks.exact_quantiles(table, "v", quantiles, [["g", "h"], ["g"], []]).collect()
    known = frame.dropna(subset="v")
    expected = {(0, *k): v for k, v in known.groupby(["g", "h"]).v}
    expected |= {(1, k, None): v for k, v in known.groupby("g").v} | {(2, None, None): known.v}
    assert {(r.keyset, r.g, r.h) for r in found} == set(expected)
    for row in found:
        values = expected[row.keyset, row.g, row.h]
        assert row.n == len(values)
        for name, q in quantiles.items():
            assert row[name] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_values_in_a_narrow_range_are_cut_finer(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SORTED_ROWS", 50)
    values = np.random.default_rng(5).uniform(20.0, 20.01, 2000)
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    found = ranks.exact_quantiles(df, "v", {"q1": 0.1, "q5": 0.5}, [["k"], []]).collect()
    assert len(found) == 2
    for r in found:
        assert (r.q1, r.q5) == pytest.approx((np.quantile(values, 0.1), np.quantile(values, 0.5)), abs=1e-12)


def test_quantiles_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", None), ("c", float("nan"))], "k string, v double")
    found = ranks.exact_quantiles(df, "v", {"q": 0.25}, [["k"]]).collect()
    assert [(r.k, r.n, r.q) for r in found] == [("a", 1, 5.0)]
    assert ranks.exact_quantiles(df.where("k = 'b'"), "v", {"q": 0.5}, [[]]).count() == 0


def test_row_numbers_equal_sorting(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({
        "k": np.where(rng.random(3000) < 0.5, "hot", rng.choice(["a", "b"], 3000)),
        "t": rng.integers(0, 40, 3000),
        "i": [hashlib.md5(str(n).encode()).hexdigest() for n in range(3000)],
    })
    df = spark.createDataFrame(frame).repartition(5).withColumns(
        {"l1": F.floor(F.col("t") / 10), "l2": F.col("t"), "l3": F.substring("i", 1, 1)}
    )
    numbered = ranks.global_row_number(df, ["k"], ["l1", "l2", "l3"], ["i"], "number")
    got = {r.i: r.number for r in numbered.select("i", "number").collect()}
    ordered = frame.sort_values(["k", "t", "i"])
    ordered["number"] = ordered.groupby("k").cumcount() + 1
    assert got == dict(zip(ordered.i, ordered.number))


def test_stratified_split_takes_the_exact_share(spark):
    labels = ["hot"] * 1700 + ["a"] * 29 + ["b"] + [None] * 11
    df = spark.createDataFrame(list(enumerate(labels)), "key int, label string").repartition(6)
    split = splits.stratified_split(df, "label", "key")
    assert split.count() == len(labels)
    tests = {r.label: r.n for r in split.where("split = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert tests == {x: math.ceil(0.2 * labels.count(x)) for x in set(labels)}
    again = splits.stratified_split(df.repartition(2), "label", "key")
    assert split.exceptAll(again).count() == 0


def test_random_split_share(spark):
    df = splits.random_split(spark.range(20000).withColumnRenamed("id", "key"), "key")
    share = df.where("split = 'test'").count() / 20000
    assert abs(share - 0.2) < 0.01


def test_infinite_values_are_ordinary_values(spark):
    values = [float("-inf"), -3.0, 0.0, 2.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = ranks.exact_quantiles(df, "v", {"q0": 0.0, "q50": 0.5, "q100": 1.0}, [[]]).first()
    assert (row.q0, row.q50, row.q100, row.n) == (values[0], 0.0, values[-1], 5)


def test_nothing_depends_on_broadcasting(spark, table, frame, monkeypatch):
    monkeypatch.setattr("triagework.session.MAX_BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ranks.exact_quantiles(table, "v", {"q": 0.25}, [["g", "h"], []]).collect()
        known = frame.dropna(subset="v")
        expected = {(0, *k): np.quantile(v, 0.25) for k, v in known.groupby(["g", "h"]).v}
        expected[1, None, None] = np.quantile(known.v, 0.25)
        assert {(r.keyset, r.g, r.h): r.q for r in found} == pytest.approx(expected)
        df = spark.range(997).withColumn("label", F.when(F.col("id") % 3 == 0, "x"))
        split = splits.stratified_split(df, "label", "id")
        assert split.where("split = 'test'").count() == math.ceil(333 * 0.2) + math.ceil(664 * 0.2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_equal_keys_are_dealt_out(spark):
    labels = ["a", "b", "c", None]
    rows = [("same", x, n) for x in labels for n in range(100)]
    df = spark.createDataFrame(rows, "key string, label string, n int").repartition(5)
    split = splits.stratified_split(df, "label", "key").persist()
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts == {(x, s): c for x in labels for s, c in (("test", 20), ("train", 80))}
    assert split.drop("split").exceptAll(df).count() == 0 and split.count() == 400


def test_some_equal_keys_keep_the_exact_share(spark):
    rows = [(f"k{n // 7}", "x", n) for n in range(703)]
    split = splits.stratified_split(spark.createDataFrame(rows, "key string, label string, n int"), "label", "key")
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts == {"test": math.ceil(703 * 0.2), "train": 703 - math.ceil(703 * 0.2)}


def test_row_numbers_keep_nulls(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), (None, None, 3), ("a", None, 4)], "k string, t int, i int")
    numbered = ranks.global_row_number(df.withColumn("l", F.col("t")), ["k"], ["l"], ["t", "i"], "no").collect()
    assert sorted((r.i, r.no) for r in numbered) == [(1, 1), (2, 3), (3, 1), (4, 2)]
