import pytest
from pyspark.sql import functions as F

from triagework.sources import queues
from triagework.sources.queues import append_to_queues, commit, committed, compact_batches, read_queues, write_attempt


def routed(spark, ids, department="billing"):
    rows = spark.createDataFrame([(f"T{i}", f"subject {i}") for i in ids], "Ticket_ID string, Ticket_Subject string")
    named = {c: F.lit(None).cast("string") for c in queues.COLUMNS if c not in ("Ticket_ID", "Ticket_Subject", "Routed_At")}
    stamp = F.lit("2024-01-01 10:00:00").cast("timestamp")
    return rows.withColumns({**named, "Routed_At": stamp, "department_key": F.lit(department), "ticket_md5": F.md5("Ticket_ID")})


def ids_in(spark, path):
    return sorted(r.Ticket_ID for r in read_queues(spark, path).select("Ticket_ID").collect())


def test_a_named_batch_is_there_once(spark, tmp_path):
    path = str(tmp_path / "q")
    for _ in range(3):
        append_to_queues(routed(spark, range(4)), path, "monday")
    append_to_queues(routed(spark, [9], "fraud"), path, "tuesday")
    append_to_queues(routed(spark, [20]), path)
    append_to_queues(routed(spark, [20]), path)
    assert ids_in(spark, path) == ["T0", "T1", "T2", "T20", "T20", "T3", "T9"]
    assert {r.department_key for r in read_queues(spark, path).collect()} == {"billing", "fraud"}


def test_a_broken_attempt_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "q")

    def lost(*_):
        raise RuntimeError("session lost")

    monkeypatch.setattr(queues, "commit", lost)
    with pytest.raises(RuntimeError):
        append_to_queues(routed(spark, range(3)), path, "monday")
    assert ids_in(spark, path) == []
    monkeypatch.undo()
    append_to_queues(routed(spark, range(3)), path, "monday")
    assert ids_in(spark, path) == ["T0", "T1", "T2"]


def test_one_of_two_attempts_wins(spark, tmp_path):
    path, name = str(tmp_path / "q"), queues.batch_name("monday")
    attempts = [write_attempt(routed(spark, range(2)), path, name) for _ in range(2)]
    assert [commit(spark, path, name, a, []) for a in attempts] == [True, False]
    assert ids_in(spark, path) == ["T0", "T1"]


def test_compaction_keeps_every_ticket_once(spark, tmp_path):
    path = str(tmp_path / "q")
    assert committed(spark, path) is None and compact_batches(spark, path, "none") == []
    for i in range(5):
        append_to_queues(routed(spark, [i], ["billing", "fraud"][i % 2]).repartition(3), path, f"batch {i}")
    before = ids_in(spark, path)
    assert len(compact_batches(spark, path, "first")) == 5 and ids_in(spark, path) == before
    assert committed(spark, path).select("attempt").distinct().count() == 1
    files = list((tmp_path / "q" / queues.BATCHES / f"batch={queues.batch_name('first')}").rglob("*.parquet"))
    assert len(files) == 2
    assert compact_batches(spark, path, "first") == []
    append_to_queues(routed(spark, [2]), path, "batch 2")
    append_to_queues(routed(spark, [7]), path, "batch 7")
    assert len(compact_batches(spark, path, "second")) == 2
    assert ids_in(spark, path) == sorted([*before, "T7"])


def test_an_empty_batch(spark, tmp_path):
    path = str(tmp_path / "q")
    append_to_queues(routed(spark, [1]).limit(0), path, "empty")
    append_to_queues(routed(spark, [1]), path, "empty")
    assert ids_in(spark, path) == []


def test_compacted_files_hold_bounded_bytes_whatever_the_keys(spark, tmp_path):
    """All tickets have one key; each has 10,000 bytes of text."""
    path = str(tmp_path / "q")
    same = F.lit("T0")
    for name, ids in (("monday", range(30)), ("tuesday", range(30, 60))):
        batch = routed(spark, ids).withColumns({
            "Ticket_Description": F.concat(F.repeat(F.lit("x"), 10_000), F.col("Ticket_Subject")), "Ticket_ID": same,
            "ticket_md5": F.md5(same),
        })
        append_to_queues(batch, path, name)
    assert len(compact_batches(spark, path, "both", bytes_per_file=100_000)) == 2
    written = spark.read.parquet(f"{path}/{queues.BATCHES}/batch={queues.batch_name('both')}")
    counts = [r["count"] for r in written.groupBy(F.input_file_name()).count().collect()]
    assert sum(counts) == 60 and len(counts) >= 6 and max(counts) <= 15
    assert read_queues(spark, path).select("Ticket_Subject").distinct().count() == 60
