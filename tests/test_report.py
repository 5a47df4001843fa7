import pytest
from pyspark.sql import functions as F

from triagework.domain import PRIORITIES
from triagework.operators import evaluate, report, routing
from triagework.operators.ranges import settled_ranges
from triagework.plans.triage import queue_rows, triage_batch
from triagework.sources import queues

PAIRS = [("High", "High"), ("High", "Low"), ("Low", "Low"), ("Low", "Low"), ("Medium", "High"), ("Low", "Odd")]


@pytest.fixture(scope="module")
def judged(spark):
    return spark.createDataFrame(PAIRS, "y string, p string")


def test_departments_by_exact_category(spark):
    rows = [("Technical",), ("Billing",), ("Fraud",), ("Account",), ("General Inquiry",), (None,), ("billing",), ("Other",)]
    df = spark.createDataFrame(rows, "c string")
    found = df.select(routing.department_of(F.col("c")).alias("d")).select("d", routing.queue_of(F.col("d"))).collect()
    assert [tuple(r) for r in found[:4]] == [
        ("Technical Support", "technical"), ("Billing", "billing"), ("Fraud & Risk", "fraud"),
        ("Account Support", "account"),
    ]
    assert {tuple(r) for r in found[4:]} == {("General Support", "general_inquiry")}
    assert spark.range(1).select(routing.queue_of(F.lit("Nowhere"))).first()[0] == "general_inquiry"


def test_ticket_ids(spark):
    ids = spark.range(50).select(routing.ticket_id("id").alias("a"), routing.ticket_id().alias("b"))
    rows = ids.collect()
    assert all(len(x) == 12 and x.startswith("TKT-") and x == x.upper() for r in rows for x in r)
    assert len({r.a for r in rows}) == 50 and len({r.b for r in rows}) == 50
    assert spark.range(50).select(routing.ticket_id("id")).collect()[7][0] == rows[7].a


def test_kpis_and_crosstab(spark):
    batch = spark.createDataFrame(
        [("High", "Billing"), ("Critical", "Billing"), ("High", "Fraud & Risk"), (None, "Fraud & Risk")],
        "predicted_priority string, routed_department string",
    )
    assert tuple(report.batch_kpis(batch).first()) == (4, 2, 1, 2)
    assert tuple(report.batch_kpis(batch.limit(0)).first()) == (0, 0, 0, 0)
    crosstab = {r.routed_department: tuple(r)[1:] for r in report.priority_by_department(batch).collect()}
    assert crosstab == {"Billing": (1, 1, 0, 0), "Fraud & Risk": (0, 1, 0, 0)}
    counts = [tuple(r) for r in report.distribution(batch, "predicted_priority").collect()]
    assert counts == [("High", 2), ("Critical", 1)]


def test_confusion_matrix_is_filled_with_zeros(judged):
    rows = evaluate.confusion_matrix(judged, "y", "p").collect()
    assert [r.actual for r in rows] == PRIORITIES
    assert [tuple(r)[1:] for r in rows] == [(0, 0, 0, 0), (0, 1, 1, 0), (0, 0, 2, 0), (0, 1, 0, 0)]


def test_report_lines(judged):
    lines = {r.label: (r.precision, r.recall, r.f1, r.support) for r in
             evaluate.classification_report(judged, "y", "p", ["High", "Low", "Medium"]).collect()}
    assert lines["High"] == (0.5, 0.5, 0.5, 2)
    assert lines["Low"] == (0.666667, 0.666667, 0.666667, 3)
    assert lines["Medium"] == (0.0, 0.0, 0.0, 1)
    assert lines["accuracy"] == (0.5, 0.5, 0.5, 6)
    assert lines["macro avg"] == (0.388889, 0.388889, 0.388889, 6)
    assert lines["weighted avg"] == (0.5, 0.5, 0.5, 6)
    assert evaluate.accuracy(judged, "y", "p").first()[0] == 0.5


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (8.0, 6.0), (None, 1.0)], "y double, p double")
    row = evaluate.regression_metrics(df, "y", "p").first()
    assert (row.rows, row.mae, row.rmse, row.r2) == (3, 1.0, 1.290994, 0.807692)
    constant = spark.createDataFrame([(1.0, 2.0)], "y double, p double")
    assert evaluate.regression_metrics(constant, "y", "p").first().r2 is None


@pytest.mark.parametrize(
    ("losses", "patience", "expected"),
    [
        ([5.0, 4.0, 3.0, 3.5, 3.0, 3.2, 2.0], 3, (5, 2, 3.0, True)),
        ([5.0, 4.0, 3.0, 2.0], 3, (3, 3, 2.0, False)),
        ([1.0, 2.0, 3.0], 50, (2, 0, 1.0, False)),
    ],
)
def test_early_stop(spark, losses, patience, expected):
    curve = spark.createDataFrame(list(enumerate(losses)), "i int, loss double")
    assert tuple(evaluate.early_stop(curve, "i", "loss", patience).first()) == expected


def test_patience_counts_from_the_minimum(spark):
    points = [(i, 1.0 + abs(i - 125) / 1000) for i in range(500)]
    row = evaluate.early_stop(spark.createDataFrame(points, "i int, loss double"), "i", "loss", 50).first()
    assert (row.stop_iteration, row.best_iteration, row.stopped_early) == (175, 125, True)


@pytest.fixture(scope="module")
def ranges(spark):
    rows = [("High", "Fraud", float(n)) for n in range(40)]
    return settled_ranges(
        spark.createDataFrame(rows, "Priority_Level string, Issue_Category string, Resolution_Time_Hours double")
    )


def test_triage_keeps_the_raw_category(spark, ranges):
    tickets = spark.createDataFrame(
        [(1, "d", None, "High"), (2, "e", "Fraud", "High")],
        "k int, Ticket_Description string, Issue_Category string, priority string",
    )
    rows = {r.k: r for r in triage_batch(tickets, ranges, "priority", ["k"]).collect()}
    assert rows[1].Issue_Category is None and rows[1].routed_department == "General Support"
    assert rows[1].expected_resolution_range == rows[2].expected_resolution_range == "9.8–29.2 hours"
    assert (rows[1].Ticket_Subject, rows[1].Ticket_Channel) == ("", "Web Form")


def test_appending_twice_numbers_on(spark, ranges, tmp_path):
    path = str(tmp_path / "queues")
    tickets = spark.range(6).select(
        F.col("id").alias("k"), F.lit("d").alias("Ticket_Description"), F.lit("Fraud").alias("Issue_Category"),
        F.lit("High").alias("p"),
    )
    batch = triage_batch(tickets, ranges, "p", ["k"])
    for stamp in ("2026-01-02 00:00:00.700", "2026-01-01 00:00:00"):
        queues.append_to_queues(queue_rows(batch, F.lit(stamp).cast("timestamp"), ["k"]), path)
    queued = queues.read_queues(spark, path)
    assert queued.count() == 12
    numbered = routing.with_queue_numbers(queued).orderBy("Queue_No").collect()
    assert [r.Queue_No for r in numbered] == list(range(1, 13))
    assert [(r.Routed_At.day, r.Ticket_ID) for r in numbered] == sorted((r.Routed_At.day, r.Ticket_ID) for r in numbered)
    depth = {r.queue_key: r.waiting for r in report.queue_depth(queued).collect()}
    assert depth == {"fraud": 12, "technical": 0, "billing": 0, "account": 0, "general_inquiry": 0}
