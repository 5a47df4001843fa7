"""Resolution ranges kept up to date as history is appended.

What is stored per appended part is how many tickets each (priority, category, hours) has; the ranges over all parts follow
exactly from these counts, so an append reads its own part only and no history is scanned again. Parts have names and are
committed like queued batches: a part that is appended twice counts once. Compaction adds the counts of all parts up in one.

Tickets without hours are not counted. Null priorities and categories are kept; they count where a range does not use them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.operators.ranges import RANGE_INPUTS, resolution_ranges
from triagework.session import broadcast_if_small
from triagework.sources.queues import BATCHES, COMMITS, batch_name, commit, commits, new_attempt
from triagework.sources.tickets import path_exists, require_columns

COUNTS_SCHEMA = "Priority_Level string, Issue_Category string, Resolution_Time_Hours double, n long"


def value_counts(history: DataFrame) -> DataFrame:
    """Tickets per priority, category and hours; counted before the shuffle."""
    require_columns(history, RANGE_INPUTS)
    hours = F.col("Resolution_Time_Hours").cast("double")
    known = history.select("Priority_Level", "Issue_Category", hours.alias("Resolution_Time_Hours"))
    known = known.where(F.col("Resolution_Time_Hours").isNotNull() & ~F.isnan("Resolution_Time_Hours"))
    return known.groupBy(*RANGE_INPUTS).agg(F.count(F.lit(1)).alias("n"))


def append_history(part: DataFrame, path: str, name: str) -> bool:
    """Add a part of the history; whether this call did it."""
    spark, batch = part.sparkSession, batch_name(name)
    if path_exists(spark, f"{path}/{COMMITS}/{batch}"):
        return False
    return _write(value_counts(part), path, batch, [])


def _write(counts: DataFrame, path: str, batch: str, replaces: list[str]) -> bool:
    attempt, folder = new_attempt(path, batch)
    counts.write.parquet(folder)
    return commit(counts.sparkSession, path, batch, attempt, replaces)


def stored_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts of all parts; a value that several parts hold has several rows."""
    if not path_exists(spark, f"{path}/{BATCHES}"):
        return spark.createDataFrame([], COUNTS_SCHEMA)
    table = spark.read.schema(f"{COUNTS_SCHEMA}, batch string, attempt string").parquet(f"{path}/{BATCHES}")
    current = broadcast_if_small(commits(spark, path))
    return table.join(current, ["batch", "attempt"], "left_semi").drop("batch", "attempt")


def stored_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The ranges over everything appended so far, as over the whole history."""
    return resolution_ranges(stored_counts(spark, path), weight="n")


def compact_history(spark: SparkSession, path: str, name: str) -> list[str]:
    """Add all parts up in one part called ``name``; the names of those it replaces."""
    replaced = [r["batch"] for r in commits(spark, path).collect()]
    if len(replaced) < 2 or path_exists(spark, f"{path}/{COMMITS}/{batch_name(name)}"):
        return []
    counts = stored_counts(spark, path).groupBy(*RANGE_INPUTS).agg(F.sum("n").alias("n"))
    return replaced if _write(counts, path, batch_name(name), replaced) else []
