"""Batch and queue reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagework.domain import PRIORITIES
from triagework.sources.queues import department_dimension


def distribution(df: DataFrame, key: str, count: str = "tickets") -> DataFrame:
    """Rows per value of ``key``, most frequent first; null is left out."""
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), key)
    )


def batch_kpis(batch: DataFrame) -> DataFrame:
    """Tickets, departments reached, critical tickets and high-priority tickets of a batch."""
    priority = F.col("predicted_priority")
    per_department = batch.groupBy("routed_department").agg(
        F.count(F.lit(1)).alias("tickets"),
        F.count_if(priority == "Critical").alias("critical"),
        F.count_if(priority == "High").alias("high"),
    )
    return per_department.agg(
        F.coalesce(F.sum("tickets"), F.lit(0)).alias("total_tickets"),
        F.count("routed_department").alias("departments"),
        F.coalesce(F.sum("critical"), F.lit(0)).alias("critical_tickets"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high_priority_tickets"),
    )


def priority_by_department(batch: DataFrame) -> DataFrame:
    """Tickets per department and priority, 0 where there are none."""
    counts = batch.groupBy("routed_department").pivot("predicted_priority", PRIORITIES).count()
    return counts.na.fill(0, PRIORITIES).orderBy("routed_department")


def queue_depth(queued: DataFrame, departments: DataFrame | None = None) -> DataFrame:
    """Tickets waiting per department, 0 for an empty queue."""
    if departments is None:
        departments = department_dimension(queued.sparkSession)
    counts = queued.groupBy(F.col("department_key").alias("queue_key")).agg(F.count("Ticket_ID").alias("waiting"))
    return departments.join(counts, "queue_key", "left").select(
        "department", "queue_key", F.coalesce("waiting", F.lit(0)).alias("waiting")
    )


def preview(df: DataFrame, order: list[str], rows: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(rows)
