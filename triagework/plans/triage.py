"""Batch triage: priority, department, expected range and ticket id for a batch, then its queues and report."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.domain import BATCH_VIEW_COLUMNS
from triagework.functions.numbers import half_even
from triagework.models.priority import SCORES, PriorityModel
from triagework.operators import report
from triagework.operators.ranges import resolution_lookup, with_range_text
from triagework.operators.routing import department_of, key_hash, queue_of, ticket_id
from triagework.sources.exports import write_csv, write_parquet
from triagework.sources.queues import append_to_queues
from triagework.sources.tickets import complete_batch, select_available, split_blank


def triage_batch(tickets: DataFrame, ranges: DataFrame | None, priority: str, keys: list[str]) -> DataFrame:
    """Add the four result columns to a batch whose priorities are in column ``priority``.

    Routing and the range use the category as it came; only the model sees the filled one. The ticket id comes from
    ``keys``; without keys it is random, and the result should be written once before it is used twice.
    """
    batch = complete_batch(tickets).withColumn("predicted_priority", F.col(priority))
    batch = batch.withColumn("routed_department", department_of(F.col("Issue_Category")))
    ranged = resolution_lookup(batch, ranges, "predicted_priority", "Issue_Category")
    ranged = with_range_text(ranged).drop("range_level", "low_hours", "high_hours")
    return ranged.withColumn("Ticket_ID", ticket_id(*keys))


def queue_rows(batch: DataFrame, routed_at: Column, keys: list[str]) -> DataFrame:
    """A triaged batch in the form of the queue table."""
    return batch.select(
        "Ticket_ID",
        "Ticket_Subject",
        "Ticket_Description",
        "Issue_Category",
        F.col("predicted_priority").alias("Priority"),
        F.col("expected_resolution_range").alias("Expected_Resolution"),
        "Ticket_Channel",
        F.col("routed_department").alias("Routed_Department"),
        F.date_trunc("second", routed_at).alias("Routed_At"),
        (key_hash(*keys) if keys else F.md5("Ticket_ID")).alias("ticket_md5"),
        queue_of(F.col("routed_department")).alias("department_key"),
    )


def route_batch(
    batch: DataFrame, path: str, routed_at: Column | None = None, keys: list[str] | None = None, name: str | None = None
) -> str:
    """Append a triaged batch to the department queues, stamped with the time of routing; a ``name`` only once."""
    stamp = F.current_timestamp() if routed_at is None else routed_at
    return append_to_queues(queue_rows(batch, stamp, keys or []), path, name)


def batch_view(batch: DataFrame) -> DataFrame:
    return select_available(batch, BATCH_VIEW_COLUMNS)


@dataclass(frozen=True)
class BatchReport:
    """The tables shown for a triaged batch."""

    kpis: DataFrame
    priorities: DataFrame
    departments: DataFrame
    priority_by_department: DataFrame
    results: DataFrame


def batch_report(batch: DataFrame) -> BatchReport:
    return BatchReport(
        report.batch_kpis(batch),
        report.distribution(batch, "predicted_priority"),
        report.distribution(batch, "routed_department"),
        report.priority_by_department(batch),
        batch_view(batch),
    )


def analyze_ticket(
    spark: SparkSession,
    model: PriorityModel | None,
    ranges: DataFrame | None,
    subject: str | None,
    description: str,
    category: str,
    channel: str,
) -> DataFrame | None:
    """One ticket with its priority, confidences in percent, department and range; None without a model.

    Pass the result to ``route_batch`` to put the ticket into its queue.
    """
    if model is None:
        return None
    columns = ["Ticket_Subject", "Ticket_Description", "Issue_Category", "Ticket_Channel"]
    ticket = spark.createDataFrame(
        [(subject, description, category, channel)], ", ".join(f"{c} string" for c in columns)
    )
    accepted, _ = split_blank(ticket)
    if accepted.isEmpty():
        raise ValueError("the ticket needs a description")
    scored = model.score(accepted)
    percent = F.transform(SCORES, lambda x: half_even(x * 100, 2))
    confident = scored.withColumn("confidence", F.map_from_arrays(F.array(*[F.lit(x) for x in model.labels]), percent))
    return triage_batch(confident.drop(SCORES, "prediction"), ranges, "predicted_label", []).drop("predicted_label")


def run_batch(
    tickets: DataFrame,
    model: PriorityModel,
    ranges: DataFrame | None,
    queues: str,
    output: str,
    keys: list[str] | None = None,
    routed_at: Column | None = None,
    name: str | None = None,
) -> BatchReport:
    """Score, triage and route a batch, export it as CSV and report on it. A batch with a ``name`` is queued once.

    The triaged batch is written to ``output`` once; queues, export and report read that table, so random ids are the
    same everywhere.
    """
    batch = complete_batch(tickets)
    scored = model.score(batch).drop(SCORES, "prediction")
    triaged = triage_batch(scored, ranges, "predicted_label", keys or []).drop("predicted_label")
    written = tickets.sparkSession.read.parquet(write_parquet(triaged, f"{output}/batch"))
    route_batch(written, queues, routed_at, keys, name)
    write_csv(written, f"{output}/predictions")
    return batch_report(written)
