"""Command line: ``spark-submit -m triagework.jobs <job> ...`` or ``python -m triagework.jobs <job> ...``."""

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.domain import ENGLISH_STOP_WORDS
from triagework.models import priority, resolution
from triagework.models.saved import load_model, save_model
from triagework.operators import evaluate, ranges, report
from triagework.operators.routing import with_queue_numbers
from triagework.plans.preprocess import preprocess, write_preprocessed
from triagework.plans.triage import run_batch
from triagework.session import build_session, store
from triagework.sources.queues import read_queues
from triagework.sources.tickets import history_path, read_ticket_csv

CLASSIFIERS = ["boosted", "categorical", "logistic", "svm"]
REGRESSORS = ["forest", "ridge"]


def history(spark: SparkSession, root: str, line_breaks: bool = False) -> DataFrame:
    """The ticket history below ``root``, stored once with a key of each row's content and place.

    Repeated tickets have keys of their own, and a lost task reads the keys that were stored.
    """
    tickets = read_ticket_csv(spark, history_path(spark, root), line_breaks=line_breaks)
    content, place = F.md5(F.to_json(F.struct("*"))), F.monotonically_increasing_id().cast("string")
    return store(tickets.withColumn("ticket_key", F.concat_ws("-", content, place)), "history")


def train(spark: SparkSession, tickets: DataFrame, root: str, kind: str) -> None:
    path = f"{root}/models/{kind}"
    if kind in REGRESSORS:
        fit = {"ridge": resolution.train_ridge, "forest": resolution.train_forest}[kind]
        pipeline, scored = fit(tickets)
        evaluate.regression_metrics(scored, resolution.HOURS, "predicted_hours", digits=3).show()
    else:
        if kind == "boosted":
            model, scored = priority.train_boosted(tickets)
        elif kind == "svm":
            model, scored = priority.train_svm(tickets)
        elif kind == "logistic":
            model, scored = priority.train_logistic(tickets, ENGLISH_STOP_WORDS)
        else:
            model, scored = priority.train_categorical_boosted(tickets)
        scored = scored.persist()
        evaluate.classification_report(scored, priority.LABEL, "predicted_label", model.labels, digits=2).show()
        evaluate.accuracy(scored, priority.LABEL, "predicted_label").show()
        evaluate.confusion_matrix(scored, priority.LABEL, "predicted_label", model.labels).show()
        scored.unpersist()
        if kind == "categorical":
            model.save(path)
            return
        pipeline = model.pipeline
    save_model(pipeline, path)


def inspect(tickets: DataFrame) -> None:
    ranges.describe_hours(tickets).show()
    for key in ("Priority_Level", "Issue_Category", "Ticket_Channel"):
        ranges.hours_by(tickets, key).orderBy(key).show()
    ranges.resolution_ranges(tickets).orderBy("range_level", "Priority_Level", "Issue_Category").show()


def load_classifier(
    spark: SparkSession, root: str, kind: str
) -> priority.PriorityModel | priority.CategoricalBoosting | None:
    """The trained classifier of this kind below ``root``, or None."""
    if kind == "categorical":
        return priority.CategoricalBoosting.load(spark, f"{root}/models/{kind}")
    pipeline = load_model(spark, f"{root}/models/{kind}")
    return None if pipeline is None else priority.PriorityModel(pipeline)


def batch(
    spark: SparkSession, past: DataFrame, tickets: DataFrame, root: str, output: str, kind: str, name: str | None = None
) -> None:
    model = load_classifier(spark, root, kind)
    if model is None:
        raise SystemExit(f"train the {kind} model first")
    shown = run_batch(tickets, model, ranges.settled_ranges(past), f"{root}/queues", output, name=name)
    for part in (shown.kpis, shown.priorities, shown.departments, shown.priority_by_department, shown.results):
        part.show(truncate=False)


def show_queues(spark: SparkSession, root: str) -> None:
    queued = read_queues(spark, f"{root}/queues")
    report.queue_depth(queued).show(truncate=False)
    with_queue_numbers(queued).orderBy("department_key", "Queue_No").show(truncate=False)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="triagework")
    parser.add_argument("--root", default=".", help="folder with data/ and models/")
    parser.add_argument("--line-breaks", action="store_true", help="CSV cells may hold line breaks; reads a file as one split")
    jobs = parser.add_subparsers(dest="job", required=True)
    jobs.add_parser("preprocess")
    jobs.add_parser("inspect")
    jobs.add_parser("queues")
    jobs.add_parser("train").add_argument("kind", choices=[*CLASSIFIERS, *REGRESSORS])
    batch_parser = jobs.add_parser("batch")
    batch_parser.add_argument("tickets")
    batch_parser.add_argument("output")
    batch_parser.add_argument("--model", choices=CLASSIFIERS, default="boosted")
    batch_parser.add_argument("--name", help="queue the batch of this name only once, however often it is run")
    chosen = parser.parse_args(arguments)
    spark = build_session()
    if chosen.job == "queues":
        show_queues(spark, chosen.root)
        return
    past = history(spark, chosen.root, chosen.line_breaks)
    if chosen.job == "preprocess":
        write_preprocessed(preprocess(past), f"{chosen.root}/data/processed")
    elif chosen.job == "inspect":
        inspect(past)
    elif chosen.job == "train":
        train(spark, past, chosen.root, chosen.kind)
    else:
        arrived = read_ticket_csv(spark, chosen.tickets, line_breaks=chosen.line_breaks)
        batch(spark, past, arrived, chosen.root, chosen.output, chosen.model, chosen.name)


if __name__ == "__main__":
    main()
