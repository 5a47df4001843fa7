import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from triagework.domain import SERVING_DEFAULTS, TRAINING_DEFAULTS
from triagework.models import features, priority, resolution, saved
from triagework.operators.ranges import settled_ranges
from triagework.operators.splits import random_split, train_part
from triagework.operators.tfidf import fit_vocabulary, tfidf_long
from triagework.plans.triage import analyze_ticket, queue_rows, route_batch, run_batch, triage_batch
from triagework.sources import queues
from triagework.streaming.routing import route_stream

WORDS = {
    "Critical": "outage everything down urgent",
    "High": "payment failed several times",
    "Low": "question about my profile",
    "Medium": "app shows an error sometimes",
}
CATEGORY = {"Critical": "Technical", "High": "Billing", "Low": "Account", "Medium": None}
TEXTS = {
    "model_Ticket_Subject": features.TermSettings(50, 1),
    "model_Ticket_Description": features.TermSettings(80, 2),
}


@pytest.fixture(scope="module")
def tickets(spark):
    """Tickets whose words give the priority away, except for some noise; a few have no priority."""
    rows = []
    for n in range(320):
        label = list(WORDS)[n % 4] if n % 16 < 12 else "Low"
        shown = label if n % 13 else "High"
        rows.append((
            n, WORDS[label].split()[n % 3] if n % 9 else None, f"{WORDS[label]} number{n % 5} please help {n}",
            CATEGORY[label], ["Email", "Chat", None][n % 3], shown if n % 31 else None,
            f"2024-0{1 + n % 9}-11 0{n % 10}:00:00", 5.0 + 20 * (n % 4) + n % 7,
        ))
    schema = (
        "ticket_key int, Ticket_Subject string, Ticket_Description string, Issue_Category string, Ticket_Channel string,"
        " Priority_Level string, Submission_Date string, Resolution_Time_Hours double"
    )
    df = spark.createDataFrame(rows, schema).withColumn("Submission_Date", F.col("Submission_Date").cast("timestamp"))
    return df.repartition(3).persist()


def check(scored, better_than=0.6):
    rows = scored.select("Priority_Level", "predicted_label", priority.SCORES).collect()
    assert rows and {r.predicted_label for r in rows} <= set(WORDS)
    assert sum(r.Priority_Level == r.predicted_label for r in rows) / len(rows) > better_than
    return rows


@pytest.fixture(scope="module")
def logistic(tickets):
    return priority.train_logistic(tickets, ("please", "about"), priority.logistic_learner(50))


def test_logistic_scores_are_probabilities(logistic):
    model, scored = logistic
    assert model.labels == sorted(WORDS)
    assert all(sum(r[priority.SCORES]) == pytest.approx(1.0) for r in check(scored))


def test_svm(tickets):
    model, scored = priority.train_svm(tickets, priority.svm_learner())
    assert len(check(scored)[0][priority.SCORES]) == 4
    assert model.labels == sorted(WORDS)


def test_boosted_scores_are_probabilities(tickets):
    learner = priority.boosted_learner(rounds=4, depth=3)
    _, scored = priority.train_boosted(tickets, learner, texts=TEXTS)
    assert all(sum(r[priority.SCORES]) == pytest.approx(1.0) for r in check(scored))


def test_categorical_boosting_keeps_the_best_rounds(tickets):
    fitted, scored = priority.train_categorical_boosted(tickets, rounds=40, depth=3, step=0.5, patience=2)
    assert fitted.labels == sorted(WORDS)
    best = min(range(len(fitted.curve)), key=fitted.curve.__getitem__)
    assert fitted.rounds == best + 1 and len(fitted.curve) == min(40, best + 3)
    assert len(fitted.pipeline.stages[1].getOrDefault("values")) == fitted.rounds * 4 * 15
    assert all(sum(r[priority.SCORES]) == pytest.approx(1.0) for r in check(scored, 0.4))


def test_categorical_model_serves_raw_tickets(spark, tickets, tmp_path):
    fitted, scored = priority.train_categorical_boosted(tickets, rounds=3, depth=3, patience=2)
    loaded = priority.CategoricalBoosting.load(spark, fitted.save(str(tmp_path / "model")))
    assert loaded.labels == sorted(WORDS)
    served = loaded.score(tickets, TRAINING_DEFAULTS).select("ticket_key", priority.SCORES)
    expected = {r.ticket_key: r[priority.SCORES] for r in scored.collect()}
    got = {r.ticket_key: r[priority.SCORES] for r in served.collect()}
    assert len(got) == tickets.count() and expected
    assert all(got[k] == pytest.approx(v) for k, v in expected.items())
    bare = spark.createDataFrame([("new words", None)], "Ticket_Description string, Issue_Category string")
    report = run_batch(bare, loaded, None, str(tmp_path / "queues"), str(tmp_path / "out"))
    assert report.results.first().predicted_priority in WORDS
    assert priority.CategoricalBoosting.load(spark, str(tmp_path / "none")) is None


def test_repeated_tickets_do_not_multiply(spark):
    rows = [("k", WORDS[x], x) for x in WORDS for _ in range(50)]
    repeated = spark.createDataFrame(rows, "ticket_key string, Ticket_Description string, Priority_Level string")
    repeated = repeated.withColumns(
        {"Ticket_Subject": F.lit("s"), "Issue_Category": F.lit("Billing"), "Ticket_Channel": F.lit("Email"),
         "Submission_Date": F.lit("2024-01-01").cast("timestamp")}
    )
    _, scored = priority.train_categorical_boosted(repeated, rounds=1, depth=2)
    assert scored.count() == 40


def test_pipeline_weights_equal_the_long_table(spark):
    texts = spark.createDataFrame([(1, "a b a b a zz yy"), (2, "zz zz zz"), (3, ""), (4, "none at all")], "ticket_key int, t string")
    vocabulary = fit_vocabulary(texts, "t", features.TermSettings(20))
    stages = PipelineModel(features.tfidf_stages("t", vocabulary))
    transformed = stages.transform(texts)
    assert "Python" not in transformed._jdf.queryExecution().toString()
    vectors = {
        (r.ticket_key, vocabulary.terms[int(i)]): v
        for r in transformed.collect()
        for i, v in zip(r.t_tfidf.indices, r.t_tfidf.values, strict=True)
    }
    long = {(r.ticket_key, r.term): r.weight for r in tfidf_long(texts, "t", vocabulary, ["ticket_key"], 9).collect()}
    assert long and vectors == pytest.approx(long, abs=1e-8)


def test_confidences_add_up(logistic, tickets):
    model, _ = logistic
    lines = priority.confidences(model.score(tickets), model.labels, ["ticket_key"])
    totals = lines.groupBy("ticket_key").agg(F.count("*").alias("n"), F.sum("confidence").alias("s")).collect()
    assert len(totals) == tickets.count()
    assert all(r.n == 4 and r.s == pytest.approx(100, abs=0.03) for r in totals)


def test_saved_model_scores_the_same(spark, logistic, tickets, tmp_path):
    model, _ = logistic
    path = str(tmp_path / "model")
    assert saved.load_model(spark, path) is None
    assert saved.missing_models(spark, {"logistic": path}) == ["logistic"]
    saved.save_model(model.pipeline, path)
    assert saved.missing_models(spark, {"logistic": path}) == []
    loaded = priority.PriorityModel(saved.load_model(spark, path))
    assert loaded.labels == model.labels
    columns = ["ticket_key", "predicted_label", priority.SCORES]
    assert loaded.score(tickets).select(columns).exceptAll(model.score(tickets).select(columns)).count() == 0


def test_unseen_values_are_all_zeros(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    stages = features.one_hot_stages(train, ["c"])
    test = spark.createDataFrame([("b",), ("z",), (None,)], "c string")
    rows = PipelineModel(stages).transform(test).collect()
    assert [list(r.c_onehot.toArray()) for r in rows] == [[0, 1], [0, 0], [0, 0]]


def test_ridge_equals_the_closed_form(tickets):
    pipeline, scored = resolution.train_ridge(tickets, iterations=1000, tolerance=1e-15)
    inputs = random_split(resolution.regression_inputs(tickets, "ticket_key"), "ticket_key")
    before = PipelineModel(pipeline.stages[:-2])
    train = before.transform(train_part(inputs)).select("features", resolution.HOURS).collect()
    x = np.array([r.features.toArray() for r in train])
    y = np.log1p([r[resolution.HOURS] for r in train])
    centred = x - x.mean(axis=0)
    weights = np.linalg.solve(centred.T @ centred + 30.0 * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    fitted = pipeline.stages[-2]
    assert fitted.coefficients.toArray() == pytest.approx(weights, abs=1e-6)
    rows = scored.collect()
    assert rows and all(0 <= r.predicted_hours <= 120 for r in rows)


def test_forest_stays_in_bounds(tickets):
    _, scored = resolution.train_forest(tickets, trees=5, depth=4)
    rows = scored.collect()
    assert rows and all(1 <= r.predicted_hours <= 120 for r in rows)


def test_batch_from_model_to_queues(spark, logistic, tickets, tmp_path):
    model, _ = logistic
    ranges = settled_ranges(tickets)
    batch = tickets.select("Ticket_Description", "Issue_Category")
    report = run_batch(batch, model, ranges, str(tmp_path / "queues"), str(tmp_path / "out"))
    queued = queues.read_queues(spark, str(tmp_path / "queues"))
    assert report.kpis.first().total_tickets == queued.count() == batch.count()
    assert {r.Ticket_ID for r in report.results.collect()} == {r.Ticket_ID for r in queued.collect()}
    assert {r.Ticket_Channel for r in queued.collect()} == {SERVING_DEFAULTS["Ticket_Channel"]}
    exported = spark.read.option("header", True).csv(str(tmp_path / "out" / "predictions"))
    assert exported.count() == batch.count()


def test_one_ticket(spark, logistic, tickets, tmp_path):
    model, _ = logistic
    ranges = settled_ranges(tickets)
    assert analyze_ticket(spark, None, ranges, "s", "d", "Billing", "Email") is None
    with pytest.raises(ValueError):
        analyze_ticket(spark, model, ranges, "s", "  ", "Billing", "Email")
    found = analyze_ticket(spark, model, ranges, "payment", WORDS["High"], "Billing", "Email").persist()
    row = found.first()
    assert (row.predicted_priority, row.routed_department) == ("High", "Billing")
    assert max(row.confidence, key=row.confidence.get) == "High"
    assert sum(row.confidence.values()) == pytest.approx(100, abs=0.03)
    route_batch(found, str(tmp_path / "queues"))
    queued = queues.read_queues(spark, str(tmp_path / "queues")).collect()
    assert [(r.Ticket_ID, r.department_key) for r in queued] == [(row.Ticket_ID, "billing")]
    unknown = analyze_ticket(spark, model, None, None, WORDS["High"], "Billing", "Email").first()
    assert unknown.expected_resolution_range == "Unavailable"


def test_arriving_tickets_are_scored(spark, logistic, tickets, tmp_path):
    model, _ = logistic
    ranges = settled_ranges(tickets)
    columns = ["ticket_key", "Ticket_Description", "Issue_Category", F.col("Submission_Date").alias("Arrived_At")]
    tickets.select(columns).write.parquet(str(tmp_path / "in"))
    landed = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(landed.schema).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "queues")
    route_stream(stream, ranges, path, str(tmp_path / "state"), ["ticket_key"], model).awaitTermination()
    completed = landed.withColumns({"Ticket_Subject": F.lit(""), "Ticket_Channel": F.lit("Web Form")})
    batch = triage_batch(model.score(completed), ranges, "predicted_label", ["ticket_key"])
    expected = queue_rows(batch, F.col("Arrived_At"), ["ticket_key"])
    got = queues.read_queues(spark, path).select(expected.columns)
    assert got.count() == tickets.count() and got.exceptAll(expected).count() == 0
