from datetime import datetime

from pyspark.sql import functions as F

from triagework.functions import dates, numbers


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return row.select(column).first()[0]


def test_ties_go_to_the_even_digit(spark):
    rounded = spark.createDataFrame([(34.25,), (34.35,), (0.05,), (-2.25,)], "x double").select(
        numbers.half_even(F.col("x"), 1)
    )
    assert [r[0] for r in rounded.collect()] == [34.2, 34.4, 0.0, -2.2]


def test_range_text_and_back(spark):
    df = spark.createDataFrame([(8.0, 34.2), (15.0, 68.0), (None, 3.0), (0.0, 120.5)], "a double, b double")
    texts = df.withColumn("t", numbers.range_text(F.col("a"), F.col("b")))
    assert [r.t for r in texts.collect()] == ["8–34.2 hours", "15–68 hours", "Unavailable", "0–120.5 hours"]
    low, high = numbers.parse_range(F.col("t"))
    back = [tuple(r) for r in texts.select(low, high).collect()]
    assert back == [(8.0, 34.2), (15.0, 68.0), (None, None), (0.0, 120.5)]


def test_broken_ranges_have_no_hours(spark):
    df = spark.createDataFrame([("5 hours",), ("a–b hours",), ("1–b hours",), (None,)], "t string")
    low, high = numbers.parse_range(F.col("t"))
    assert [tuple(r) for r in df.select(low, high).collect()] == [(None, None)] * 4


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (5.0,), (500.0,), (None,)], "x double")
    assert [r[0] for r in df.select(numbers.clip(F.col("x"), 0, 120)).collect()] == [0.0, 5.0, 120.0, None]


def test_unreadable_dates_take_the_defaults(spark):
    df = spark.createDataFrame([("2024-03-05 14:30:00",), ("garbage",), (None,)], "t string")
    parsed = df.select(dates.parse_submission(F.col("t")).alias("ts"))
    assert parsed.first()[0] == datetime(2024, 3, 5, 14, 30)
    zero = [tuple(r) for r in parsed.select(*dates.calendar_parts(F.col("ts")).values()).collect()]
    assert zero == [(2024, 3, 5, 1, 14), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0)]
    noon = [tuple(r) for r in parsed.select(*dates.regression_parts(F.col("ts")).values()).collect()]
    assert noon == [(14, 1, 3), (12, 0, 1), (12, 0, 1)]


def test_dates_are_read_leniently(spark):
    expected = {
        "2024-03-15": datetime(2024, 3, 15),
        "2024-03-15T08:01:02": datetime(2024, 3, 15, 8, 1, 2),
        "15/03/2024": datetime(2024, 3, 15),
        "03/15/2024 08:00": datetime(2024, 3, 15, 8),
        "3/4/2024": datetime(2024, 3, 4),
        "Mar 3 2024": datetime(2024, 3, 3),
        "March 3, 2024 9:05": datetime(2024, 3, 3, 9, 5),
        "3 Mar 2024": datetime(2024, 3, 3),
        "2024/3/5 7:06:05": datetime(2024, 3, 5, 7, 6, 5),
        "25-12-2024": datetime(2024, 12, 25),
        "garbage": None,
        "13/13/2024": None,
        None: None,
    }
    rows = spark.createDataFrame([(t,) for t in expected], "t string").select("t", dates.parse_submission(F.col("t"))).collect()
    assert {r[0]: r[1] for r in rows} == expected
