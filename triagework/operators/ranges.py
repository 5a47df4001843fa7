"""Expected resolution ranges, their fallback and resolution-time statistics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagework.domain import MIN_PAIR_COUNT
from triagework.functions.numbers import half_even, range_text
from triagework.operators.ranks import exact_quantiles
from triagework.session import broadcast_if, is_small, settle
from triagework.sources.tickets import require_columns

RANGE_INPUTS = ["Priority_Level", "Issue_Category", "Resolution_Time_Hours"]
LEVELS = ["pair", "priority", "all"]


def resolution_ranges(history: DataFrame, weight: str | None = None) -> DataFrame:
    """Interquartile range and known-hours count per (priority, category), per priority and over everything.

    With ``weight`` a row of the history stands for that many tickets.
    """
    require_columns(history, RANGE_INPUTS)
    keysets = [["Priority_Level", "Issue_Category"], ["Priority_Level"], []]
    quartiles = exact_quantiles(history, "Resolution_Time_Hours", {"q25": 0.25, "q75": 0.75}, keysets, weight)
    return quartiles.select(
        F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("keyset") + 1).alias("range_level"),
        "Priority_Level",
        "Issue_Category",
        "n",
        half_even(F.col("q25"), 1).alias("low_hours"),
        half_even(F.col("q75"), 1).alias("high_hours"),
    )


def available_ranges(history: DataFrame | None) -> DataFrame | None:
    """Settled ranges for serving: None without a history, or with one that lacks a column."""
    if history is None or not set(RANGE_INPUTS) <= set(history.columns):
        return None
    return settled_ranges(history)


def resolution_lookup(
    tickets: DataFrame,
    ranges: DataFrame | None,
    priority: str = "Priority_Level",
    category: str = "Issue_Category",
    min_pair_count: int = MIN_PAIR_COUNT,
) -> DataFrame:
    """Add each ticket's range: the pair's with enough known hours, else its priority's, else the overall one.

    ``ranges`` is read three times, so pass a settled table; without one no ticket has a range. Adds ``range_level``,
    ``low_hours`` and ``high_hours``.
    """
    if ranges is None:
        nothing = {"range_level": "string", "low_hours": "double", "high_hours": "double"}
        return tickets.withColumns({name: F.lit(None).cast(kind) for name, kind in nothing.items()})

    def level(name: str, keys: dict[str, str], prefix: str) -> DataFrame:
        return ranges.where(F.col("range_level") == name).select(
            *[F.col(source).alias(target) for source, target in keys.items()],
            *[F.col(c).alias(f"__{prefix}_{c}") for c in ("low_hours", "high_hours", "n")],
        )

    pairs = level("pair", {"Priority_Level": "__p", "Issue_Category": "__c"}, "pair")
    pairs = pairs.where(F.col("__pair_n") >= min_pair_count)
    priorities = level("priority", {"Priority_Level": "__p"}, "priority")
    overall = ranges.where(F.col("range_level") == "all").select("low_hours", "high_hours").first()
    small = is_small(ranges)

    found = tickets.join(
        broadcast_if(small, pairs), (F.col(priority) == F.col("__p")) & (F.col(category) == F.col("__c")), "left"
    ).drop("__p", "__c")
    found = found.join(broadcast_if(small, priorities), F.col(priority) == F.col("__p"), "left").drop("__p")
    low_all, high_all = overall if overall else (None, None)
    is_pair, is_priority = F.col("__pair_n").isNotNull(), F.col("__priority_n").isNotNull()

    def choose(name: str, fallback: float | None):
        last = F.lit(fallback).cast("double")
        return F.when(is_pair, F.col(f"__pair_{name}")).when(is_priority, F.col(f"__priority_{name}")).otherwise(last)

    last_level = F.lit("all") if overall else F.lit(None).cast("string")
    result = found.withColumns(
        {
            "range_level": F.when(is_pair, F.lit("pair")).when(is_priority, F.lit("priority")).otherwise(last_level),
            "low_hours": choose("low_hours", low_all),
            "high_hours": choose("high_hours", high_all),
        }
    )
    return result.drop(*[c for c in result.columns if c.startswith(("__pair_", "__priority_"))])


def with_range_text(tickets: DataFrame, name: str = "expected_resolution_range") -> DataFrame:
    return tickets.withColumn(name, range_text(F.col("low_hours"), F.col("high_hours")))


def settled_ranges(history: DataFrame) -> DataFrame:
    return settle(resolution_ranges(history))


def describe_hours(history: DataFrame, hours: str = "Resolution_Time_Hours", digits: int = 6) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum of the hours, as one row."""
    known = history.select(F.col(hours).alias("h")).where(F.col("h").isNotNull() & ~F.isnan("h"))
    moments = known.agg(
        F.count("h").alias("count"),
        half_even(F.avg("h"), digits).alias("mean"),
        half_even(F.stddev_samp("h"), digits).alias("std"),
        F.min("h").alias("min"),
        F.max("h").alias("max"),
        F.lit(0).alias("keyset"),
    )
    quartiles = exact_quantiles(history, hours, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, [[]])
    columns = {q: half_even(F.col(q), digits) for q in ("q25", "q50", "q75")}
    return (
        moments.join(quartiles.drop("n"), "keyset", "left")
        .withColumns(columns)
        .select("count", "mean", "std", "min", "q25", "q50", "q75", "max")
    )


def hours_by(history: DataFrame, key: str, hours: str = "Resolution_Time_Hours", digits: int = 2) -> DataFrame:
    """Count, mean, median and deviation of the hours per value of ``key``; null keys are left out."""
    known = history.where(F.col(key).isNotNull()).select(key, F.when(~F.isnan(hours), F.col(hours)).alias("h"))
    moments = known.groupBy(key).agg(
        F.count("h").alias("count"),
        half_even(F.avg("h"), digits).alias("mean"),
        half_even(F.stddev_samp("h"), digits).alias("std"),
    )
    medians = exact_quantiles(known, "h", {"median": 0.5}, [[key]]).select(
        key, half_even(F.col("median"), digits).alias("median")
    )
    return moments.join(medians, key, "left").select(key, "count", "mean", "median", "std")
