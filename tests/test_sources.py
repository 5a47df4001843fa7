from datetime import datetime

import pytest
from pyspark.sql import functions as F

from triagework.domain import TRAINING_DEFAULTS
from triagework.session import new_output_dir, shared_dir
from triagework.sources import exports, queues, standins, tickets

HEADER = "Ticket_Subject,Ticket_Description,Issue_Category,Ticket_Channel,Priority_Level,Submission_Date"


@pytest.fixture()
def history_file(tmp_path):
    rows = [
        HEADER + ",Resolution_Time_Hours,Agent",
        'Login,"two\nlines, ""quoted""",Account,Email,High,2024-01-02 03:04:05,12.5,ann',
        "NA,null,NaN,None,n/a,garbage,abc,NULL",
        " padded ,x,,Chat,Low,2024-01-03,7,bob",
    ]
    folder = tmp_path / "data"
    folder.mkdir()
    (folder / "customer_support_tickets.csv").write_text("\n".join(rows) + "\n")
    return tmp_path


def test_csv_types_null_tokens_and_line_breaks(spark, history_file):
    path = tickets.history_path(spark, str(history_file))
    rows = tickets.read_ticket_csv(spark, path, line_breaks=True).collect()
    assert rows[0].Ticket_Description == 'two\nlines, "quoted"'
    assert rows[0].Submission_Date == datetime(2024, 1, 2, 3, 4, 5)
    assert rows[0].Resolution_Time_Hours == 12.5 and rows[0].Agent == "ann"
    assert list(rows[1]) == [None] * 8
    assert rows[2].Ticket_Subject == " padded " and rows[2].Issue_Category is None


def test_raw_folder_comes_first(spark, history_file):
    raw = history_file / "data" / "raw"
    raw.mkdir()
    (raw / "customer_support_tickets.csv").write_text(HEADER + "\n")
    assert "/raw/" in tickets.history_path(spark, str(history_file))


def test_no_history_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tickets.history_path(spark, str(tmp_path))


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match=r"Missing columns: \['b'\]"):
        tickets.require_columns(spark.range(1).withColumn("a", F.lit(1)), ["a", "b"])


def test_batch_columns_are_completed(spark):
    row = tickets.complete_batch(spark.createDataFrame([("d", None)], "Ticket_Description string, Ticket_Channel string"))
    assert row.first().asDict() == {
        "Ticket_Description": "d", "Ticket_Channel": None, "Ticket_Subject": "", "Issue_Category": "General Inquiry",
    }
    with pytest.raises(ValueError):
        tickets.complete_batch(spark.range(1))


def test_defaults_fill_nulls_only(spark):
    df = spark.createDataFrame([(None, "", None, "Chat")], ", ".join(f"{c} string" for c in TRAINING_DEFAULTS))
    assert list(tickets.fill_defaults(df, TRAINING_DEFAULTS).first()) == ["", "", "Unknown", "Chat"]


def test_csv_export_reads_back(spark, tmp_path):
    rows = [("1", ' a "b", c\r\nd ', None), ("2", "ü\t", "x")]
    path = exports.write_csv(spark.createDataFrame(rows, "k string, t string, n string"), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in tickets.read_ticket_csv(spark, path, line_breaks=True).collect()) == rows


def test_available_columns_in_order(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    assert tickets.select_available(df, ["a", "x", "b"]).columns == ["a", "b"]


def test_queues_without_table_are_empty(spark, tmp_path):
    scanned = queues.scan_queues(spark, str(tmp_path / "none")).collect()
    assert sorted(r.queue_key for r in scanned) == ["account", "billing", "fraud", "general_inquiry", "technical"]
    assert all(r.Ticket_ID is None for r in scanned)


def test_shared_dir_is_one_folder(spark):
    assert new_output_dir(spark, "x").startswith(shared_dir(spark) + "/x-")
    assert spark.sparkContext.getCheckpointDir() is not None


class Elsewhere:
    """Stands for a session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_must_name_its_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Elsewhere)


def test_thread_keeps_first_user_turn(spark, small):
    thread = standins.ticket_thread(spark, small)
    turns = spark.read.parquet(f"{small}/conversations.parquet").where("role = 'user'").toPandas()
    first = turns.sort_values("turn").groupby("conv_id").text.first().to_dict()
    assert {r.ticket_key: r.Ticket_Description for r in thread.collect()} == first


def test_large_csv_is_split(spark, tmp_path):
    lines = [HEADER, *[f"s{n},{'word ' * 30},Billing,Email,Low,2024-01-02" for n in range(20_000)]]
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        read = tickets.read_ticket_csv(spark, str(tmp_path / "big.csv"))
        assert read.rdd.getNumPartitions() > 4 and read.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
