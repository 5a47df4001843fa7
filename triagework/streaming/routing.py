"""Tickets routed as they arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from triagework.models.priority import PriorityModel
from triagework.operators.routing import department_of
from triagework.plans.triage import queue_rows, triage_batch
from triagework.sources.queues import stream_path
from triagework.sources.tickets import complete_batch


def read_stream(spark: SparkSession, folder: str, file_name: str) -> DataFrame:
    """Stream of the Parquet files in ``folder`` that match ``file_name``."""
    schema = spark.read.parquet(f"{folder}/{file_name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file_name).parquet(folder)


def drop_repeats(tickets: DataFrame, key: str, arrival: str, within: str) -> DataFrame:
    """Drop tickets that arrive again ``within`` the watermark; what is kept in state is bounded by it."""
    return tickets.withWatermark(arrival, within).dropDuplicatesWithinWatermark([key])


def route_stream(
    tickets: DataFrame,
    ranges: DataFrame | None,
    path: str,
    checkpoint: str,
    keys: list[str],
    model: PriorityModel | None = None,
) -> StreamingQuery:
    """Triage arriving tickets against a settled range table and append them to the queues at ``path``.

    The priority is the model's, or column ``Priority_Level`` without a model. The stream has a table of its own below
    ``path``, named after its checkpoint: its commit log lists each micro-batch once, and batch writers beside it are
    not in that log.
    """
    if model is None:
        batch = triage_batch(tickets, ranges, "Priority_Level", keys)
    else:
        batch = triage_batch(model.score(complete_batch(tickets)), ranges, "predicted_label", keys)
    routed = queue_rows(batch, F.col("Arrived_At"), keys)
    return (
        routed.writeStream.format("parquet")
        .partitionBy("department_key")
        .option("path", stream_path(path, checkpoint))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def live_depth(tickets: DataFrame) -> DataFrame:
    """Running number of tickets per department."""
    department = department_of(F.col("Issue_Category")).alias("department")
    return tickets.groupBy(department).agg(F.count(F.lit(1)).alias("waiting"))


def publish_depth(depth: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rewrite the depth table at ``path`` after every micro-batch."""

    def rewrite(current: DataFrame, _batch: int) -> None:
        current.write.mode("overwrite").parquet(path)

    return (
        depth.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(rewrite)
        .start()
    )
