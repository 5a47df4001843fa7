import hashlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from triagework.operators import encode


def test_labels_are_numbered_alphabetically(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "Priority_Level string")
    assert [tuple(r) for r in encode.label_mapping(df).orderBy("code").collect()] == [("a", 0), ("b", 1)]


@pytest.mark.parametrize(
    "layout",
    [
        {"High": 0, "Low": 1},
        {"label_to_number": {"High": 0, "Low": 1}},
        {"label_to_number": {}, "number_to_label": {"0": "High", "1": "Low"}},
    ],
)
def test_codes_from_either_layout(spark, layout):
    mapping = encode.mapping_from_dict(spark, layout)
    df = spark.createDataFrame([(0,), (1,), (7,), (None,)], "label_code int")
    labels = {r.label_code: r.label for r in encode.decode_labels(df, mapping).collect()}
    assert labels == {0: "High", 1: "Low", 7: "7", None: None}
    back = encode.encode_labels(spark.createDataFrame([("Low",), ("x",)], "Priority_Level string"), mapping)
    assert {r.Priority_Level: r.label_code for r in back.collect()} == {"Low": 1, "x": None}


def test_constant_columns_are_not_scaled(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "a double, b double")
    deviations = encode.population_deviations(df, ["a", "b"])
    assert deviations == {"a": 1.0, "b": 1.0}
    df = df.withColumn("a", F.col("a") * 10)
    scaled = encode.scale_by_deviation(df, encode.population_deviations(df, ["a", "b"]))
    assert sorted(r.a_scaled for r in scaled.collect()) == [1.0, 3.0]
    assert [r.b_scaled for r in scaled.collect()] == [3.0, 3.0]


@pytest.mark.parametrize("few_values", [True, False])
@pytest.mark.parametrize("hot_share", [1, 3, 1000])
def test_target_means_leave_out_the_own_fold(spark, monkeypatch, few_values, hot_share):
    monkeypatch.setattr(encode, "HOT_SHARE", hot_share)
    rows = [
        (n, "hot" if n % 3 else f"c{n % 7}", "test" if n % 4 == 0 else "train", (n * 7) % 5 // 3) for n in range(300)
    ] + [(1000, None, "test", 1), (1001, "new", "test", 0), (1002, None, "train", 1)]
    df = spark.createDataFrame(rows, "key int, cat string, split string, y int").repartition(3)
    got = encode.target_encode(df, "cat", {"e": "y"}, "key", few_values, folds=4)
    assert got.columns == ["key", "cat", "split", "y", "e"] and got.count() == len(rows)
    frame = pd.DataFrame(rows, columns=["key", "cat", "split", "y"]).fillna({"cat": ""})
    frame["fold"] = [int(hashlib.md5(str(k).encode()).hexdigest()[:6], 16) % 4 for k in frame.key]
    train = frame[frame.split == "train"]
    for row in got.collect():
        seen = train[train.cat == (row.cat or "")]
        if row.split == "train":
            seen = seen[seen.fold != int(hashlib.md5(str(row.key).encode()).hexdigest()[:6], 16) % 4]
        assert row.e == pytest.approx((seen.y.sum() + train.y.mean()) / (len(seen) + 1))


@pytest.mark.parametrize("few_values", [True, False])
def test_ordered_means_see_earlier_rows_only(spark, few_values):
    rows = [
        (i % 190, ["a", "b", None, "c"][i % 4] if i % 5 else "hot", i * 7 % 3 == 0, "train" if i % 6 else "test")
        for i in range(400)
    ]
    df = spark.createDataFrame([(k, c, int(t), s) for k, c, t, s in rows], "k int, c string, t int, split string")
    train = [(hashlib.md5(str(k).encode()).hexdigest(), k, t, c) for k, c, t, s in rows if s == "train"]
    train.sort(key=lambda r: r[:3])
    prior = sum(t for _, _, t, _ in train) / len(train)
    want, sums = [], {}
    for _, k, t, c in train:
        n, hits = sums.get(c or "", (0, 0))
        want.append((k, c, int(t), "train", (hits + 2 * prior) / (n + 2)))
        sums[c or ""] = n + 1, hits + t
    for k, c, t, s in rows:
        if s == "test":
            n, hits = sums.get(c or "", (0, 0))
            want.append((k, c, int(t), s, (hits + 2 * prior) / (n + 2)))
    order = lambda r: tuple(map(str, r[:4])) + (round(r[4], 9),)
    for pieces in (200_000, 7):
        got = encode.ordered_target_encode(df, "c", {"m": "t"}, "k", few_values, 2.0, piece_rows=pieces).collect()
        assert [order(r) for r in sorted(map(tuple, got), key=order)] == [order(r) for r in sorted(want, key=order)]


def test_ordered_means_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a", 1, "test")], "k int, c string, t int, split string")
    assert encode.ordered_target_encode(df, "c", {"m": "t"}, "k", True).first().m == 0.0
