import pytest
from pyspark.sql import functions as F

from triagework.operators.ranges import settled_ranges
from triagework.operators.routing import with_queue_numbers
from triagework.plans.triage import queue_rows, route_batch, triage_batch
from triagework.sources import queues, standins
from triagework.sources.tables import read_table
from triagework.streaming import routing as streaming


@pytest.fixture(scope="module")
def ranges(spark, small):
    return settled_ranges(standins.ticket_history(spark, small))


def test_stream_equals_batch_and_resumes(spark, small, ranges, tmp_path):
    events = read_table(spark, small, "events")
    landing, queue, state = (str(tmp_path / n) for n in ("in", "queue", "state"))
    expected = queue_rows(
        triage_batch(standins.arriving_tickets(events), ranges, "Priority_Level", ["ticket_key"]),
        F.col("Arrived_At"),
        ["ticket_key"],
    )
    half = F.col("event_id") < 500
    for part in (half, ~half):
        events.where(part).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(events.schema).parquet(landing)
        arriving = standins.arriving_tickets(stream)
        streaming.route_stream(arriving, ranges, queue, state, ["ticket_key"]).awaitTermination()
    got = queues.read_queues(spark, queue).select(expected.columns)
    assert got.count() == events.count()
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def test_repeats_are_dropped_on_request(spark, small, ranges, tmp_path):
    events = read_table(spark, small, "events")
    landing, queue, state = (str(tmp_path / n) for n in ("in", "queue", "state"))
    events.union(events).write.parquet(landing)
    stream = spark.readStream.schema(events.schema).parquet(landing)
    arriving = streaming.drop_repeats(standins.arriving_tickets(stream), "ticket_key", "Arrived_At", "60 days")
    streaming.route_stream(arriving, ranges, queue, state, ["ticket_key"]).awaitTermination()
    assert queues.read_queues(spark, queue).count() == events.count()


def test_live_depth_equals_batch(spark, small, tmp_path):
    stream = standins.arriving_tickets(streaming.read_stream(spark, small, "events.parquet"))
    path = str(tmp_path / "depth")
    streaming.publish_depth(streaming.live_depth(stream), path, str(tmp_path / "state")).awaitTermination()
    batch = streaming.live_depth(standins.arriving_tickets(read_table(spark, small, "events")))
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {tuple(r) for r in batch.collect()}


@pytest.mark.parametrize("stream_first", [True, False])
def test_batches_and_streams_share_the_queues(spark, small, ranges, tmp_path, stream_first):
    events = read_table(spark, small, "events")
    landing, queue, state = (str(tmp_path / n) for n in ("in", "queue", "state"))
    half = F.col("event_id") < 400
    events.where(half).write.parquet(landing)

    def by_stream():
        stream = spark.readStream.schema(events.schema).parquet(landing)
        streaming.route_stream(standins.arriving_tickets(stream), ranges, queue, state, ["ticket_key"]).awaitTermination()

    def by_batch():
        arrived = standins.arriving_tickets(events.where(~half))
        route_batch(triage_batch(arrived, ranges, "Priority_Level", ["ticket_key"]), queue, F.col("Arrived_At"), ["ticket_key"])

    for write in (by_stream, by_batch) if stream_first else (by_batch, by_stream):
        write()
    assert queues.read_queues(spark, queue).count() == events.count()
    numbered = with_queue_numbers(queues.read_queues(spark, queue))
    assert numbered.count() == events.count()


def test_tickets_without_arrival_time_get_numbers(spark, ranges, tmp_path):
    tickets = spark.createDataFrame(
        [(1, "a", "Billing"), (2, "b", "Billing"), (3, "c", None)],
        "ticket_key int, Ticket_Description string, Issue_Category string",
    ).withColumn("Priority_Level", F.lit("Low"))
    arrived = F.when(F.col("ticket_key") != 2, F.lit("2026-01-01").cast("timestamp"))
    batch = triage_batch(tickets.withColumn("Arrived_At", arrived), ranges, "Priority_Level", ["ticket_key"])
    path = route_batch(batch, str(tmp_path / "q"), F.col("Arrived_At"), ["ticket_key"])
    numbered = with_queue_numbers(queues.read_queues(spark, path)).collect()
    assert sorted((r.department_key, r.Queue_No) for r in numbered) == [("billing", 1), ("billing", 2), ("general_inquiry", 1)]
