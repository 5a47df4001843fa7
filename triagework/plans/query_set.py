"""The registered queries: each runs one operator or job over the whole test tables."""

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.domain import ENGLISH_STOP_WORDS, PRIORITIES, SERVING_DEFAULTS, TRAINING_DEFAULTS
from triagework.functions import dates, numbers, text
from triagework.models import features, priority, resolution, saved
from triagework.operators import encode, evaluate, range_store, ranges, report, routing, splits, tfidf
from triagework.plans import triage
from triagework.plans.preprocess import preprocess
from triagework.session import new_output_dir, store
from triagework.sources import exports, queues, standins, tickets
from triagework.sources.tables import read_table
from triagework.streaming import routing as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HISTORY_COLUMNS = [
    "ticket_key", "Issue_Category", "Ticket_Channel", "Priority_Level", "Submission_Date", "Resolution_Time_Hours",
]
DESCRIPTION_TERMS = tfidf.TermSettings(max_terms=7500, min_documents=2)
SUBJECT_TERMS = tfidf.TermSettings(max_terms=2500, min_documents=2)
RESOLUTION_TERMS = tfidf.TermSettings(max_terms=5000)
MORNING, NOON = "2026-01-01 08:00:00", "2026-01-01 12:00:00"
STAMP = "yyyy-MM-dd HH:mm:ss"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Scans, sources and sinks


@query
def scan_tickets(spark, folder):
    """The history written as CSV and read again."""
    path = exports.write_csv(standins.ticket_history(spark, folder), new_output_dir(spark, "history-csv"))
    history = tickets.require_columns(tickets.read_ticket_csv(spark, path), HISTORY_COLUMNS)
    return history.withColumns(
        {"ticket_key": F.col("ticket_key").cast("long"), "Submission_Date": F.date_format("Submission_Date", STAMP)}
    ).select(HISTORY_COLUMNS)


@query
def batch_defaults(spark, folder):
    batch = standins.ticket_text(spark, folder).select("ticket_key", "Ticket_Description")
    return tickets.complete_batch(batch)


@query
def export_roundtrip(spark, folder):
    path = exports.write_csv(standins.ticket_text(spark, folder), new_output_dir(spark, "export"))
    read = tickets.read_ticket_csv(spark, path, line_breaks=True)
    return read.withColumn("ticket_key", F.col("ticket_key").cast("long"))


def text_ranges(spark, folder):
    return ranges.settled_ranges(standins.ticket_history(spark, folder))


def triaged_text(spark, folder):
    batch = standins.ticket_text(spark, folder)
    return triage.triage_batch(batch, text_ranges(spark, folder), "Priority_Level", ["ticket_key"])


def routed_queues(spark, folder):
    """Queues after two routing runs: tickets by e-mail in the morning, the others at noon."""
    batch, path = store(triaged_text(spark, folder), "triaged"), new_output_dir(spark, "queues")
    by_mail = F.col("Ticket_Channel").eqNullSafe("Email")
    for part, stamp in ((by_mail, MORNING), (~by_mail, NOON)):
        triage.route_batch(batch.where(part), path, F.lit(stamp).cast("timestamp"), ["ticket_key"])
    return queues.read_queues(spark, path)


def shown(queued):
    return queued.withColumn("Routed_At", F.date_format("Routed_At", STAMP))


@query
def route_append(spark, folder):
    return shown(routed_queues(spark, folder)).drop("ticket_md5")


@query
def route_retried(spark, folder):
    """The same two runs as batches with names, each run again, and compacted in between."""
    batch, path = store(triaged_text(spark, folder), "triaged"), new_output_dir(spark, "queues")
    by_mail = F.col("Ticket_Channel").eqNullSafe("Email")
    for name, part, stamp in (("mail", by_mail, MORNING), ("others", ~by_mail, NOON), ("mail", by_mail, NOON)):
        triage.route_batch(batch.where(part), path, F.lit(stamp).cast("timestamp"), ["ticket_key"], name)
    queues.compact_batches(spark, path, "both")
    triage.route_batch(batch.where(~by_mail), path, F.lit(NOON).cast("timestamp"), ["ticket_key"], "others")
    return shown(queues.read_queues(spark, path)).drop("ticket_md5")


def error_queues(spark, folder):
    """Queues of all events, where only errors have a known category: three departments stay empty."""
    arrived = standins.arriving_tickets(read_table(spark, folder, "events"))
    known = F.when(F.col("Issue_Category") == "Technical", F.col("Issue_Category"))
    batch = triage.triage_batch(
        arrived.withColumn("Issue_Category", known), text_ranges(spark, folder), "Priority_Level", ["ticket_key"]
    )
    path = new_output_dir(spark, "queues")
    return triage.route_batch(batch, path, F.col("Arrived_At"), ["ticket_key"])


@query
def queue_scan(spark, folder):
    scanned = queues.scan_queues(spark, error_queues(spark, folder))
    return shown(scanned).select("department", "queue_key", "Ticket_ID", "Priority", "Expected_Resolution", "Routed_At")


@query
def queue_depth(spark, folder):
    return report.queue_depth(queues.read_queues(spark, error_queues(spark, folder)))


# Projections, filters and scalar functions


def with_clean(df, cleaner):
    return df.select("ticket_key", *[cleaner(F.col(c)).alias(c) for c in ("Ticket_Subject", "Ticket_Description")])


@query
def clean_text(spark, folder):
    return with_clean(standins.ticket_text(spark, folder), text.clean_strict)


@query
def clean_html(spark, folder):
    return with_clean(standins.ticket_html(spark, folder), text.clean_strict)


@query
def clean_text_light(spark, folder):
    return with_clean(standins.ticket_html(spark, folder), text.clean_light)


@query
def clean_thread(spark, folder):
    thread = standins.ticket_thread(spark, folder)
    return thread.withColumn("Ticket_Description", text.clean_strict(F.col("Ticket_Description")))


@query
def null_defaults(spark, folder):
    batch = standins.ticket_text(spark, folder).select("ticket_key", *TRAINING_DEFAULTS)
    training = tickets.fill_defaults(batch, TRAINING_DEFAULTS).select(
        "ticket_key", F.lit("training").alias("used_in"), *TRAINING_DEFAULTS
    )
    serving = tickets.fill_defaults(batch, SERVING_DEFAULTS).select(
        "ticket_key", F.lit("serving").alias("used_in"), *SERVING_DEFAULTS
    )
    return training.unionByName(serving)


@query
def model_text(spark, folder):
    combined = text.model_text(F.col("Issue_Category"), F.col("Ticket_Subject"), F.col("Ticket_Description"))
    return standins.ticket_text(spark, folder).select("ticket_key", combined.alias("model_text"))


@query
def resolution_text(spark, folder):
    combined = text.resolution_text(F.col("Ticket_Subject"), F.col("Ticket_Description"))
    return standins.ticket_text(spark, folder).select("ticket_key", combined.alias("resolution_text"))


@query
def text_stats_strict(spark, folder):
    cleaned = with_clean(standins.ticket_text(spark, folder), text.clean_strict)
    statistics = text.strict_statistics(F.col("Ticket_Subject"), F.col("Ticket_Description"))
    return cleaned.select("ticket_key", *[c.alias(n) for n, c in statistics.items()])


@query
def text_stats_light(spark, folder):
    cleaned = with_clean(standins.ticket_text(spark, folder), text.clean_light)
    statistics = text.light_statistics(F.col("Ticket_Subject"), F.col("Ticket_Description"))
    return cleaned.select("ticket_key", *[c.alias(n) for n, c in statistics.items()])


def dated(spark, folder, parts):
    history = standins.ticket_history(spark, folder)
    # Every channel but e-mail has a date that cannot be read.
    written = F.when(F.col("Ticket_Channel") == "Email", F.date_format("Submission_Date", STAMP)).otherwise("garbage")
    parsed = dates.parse_submission(written)
    return history.select("ticket_key", *[c.alias(n) for n, c in parts(parsed).items()])


@query
def date_features_zero(spark, folder):
    return dated(spark, folder, dates.calendar_parts)


@query
def date_features_default(spark, folder):
    return dated(spark, folder, dates.regression_parts)


@query
def clip_log_roundtrip(spark, folder):
    hours = F.col("Resolution_Time_Hours")
    back = numbers.unlog_hours(numbers.log_hours(hours) * 1.1, 0, 120)
    return standins.ticket_history(spark, folder).select(
        "ticket_key",
        numbers.half_even(numbers.log_hours(hours), 6).alias("log_hours"),
        numbers.half_even(back, 6).alias("hours_0_120"),
        numbers.half_even(numbers.clip(back, 1, 120), 6).alias("hours_1_120"),
    )


@query
def route_department(spark, folder):
    department = routing.department_of(F.col("Issue_Category"))
    return standins.ticket_text(spark, folder).select(
        "ticket_key",
        "Issue_Category",
        department.alias("department"),
        routing.queue_of(department).alias("queue_key"),
    )


def with_range(spark, folder):
    low = numbers.half_even(F.col("Resolution_Time_Hours"), 1)
    high = numbers.half_even(F.col("Resolution_Time_Hours") * 1.5, 1)
    return standins.ticket_history(spark, folder).select(
        "ticket_key", numbers.range_text(low, high).alias("range_text")
    )


@query
def range_text(spark, folder):
    return with_range(spark, folder)


@query
def range_parse(spark, folder):
    low, high = numbers.parse_range(F.col("range_text"))
    return with_range(spark, folder).select("ticket_key", low.alias("low_hours"), high.alias("high_hours"))


@query
def ticket_id(spark, folder):
    return standins.ticket_text(spark, folder).select(
        "ticket_key", routing.ticket_id("ticket_key").alias("Ticket_ID")
    )


@query
def blank_rejects(spark, folder):
    accepted, rejected = tickets.split_blank(
        standins.ticket_text(spark, folder).select("ticket_key", "Ticket_Subject"), "Ticket_Subject"
    )
    return rejected.withColumn("outcome", F.lit("rejected")).unionByName(
        accepted.withColumn("outcome", F.lit("accepted"))
    )


@query
def dropna_subset(spark, folder):
    columns = ["Priority_Level", "Issue_Category", "Ticket_Channel", "Resolution_Time_Hours"]
    return tickets.drop_incomplete(standins.ticket_history(spark, folder), columns).select("ticket_key", *columns)


@query
def preview(spark, folder):
    return report.preview(scan_tickets(spark, folder), ["ticket_key"])


# Ranges and statistics


@query
def resolution_ranges(spark, folder):
    return ranges.resolution_ranges(standins.ticket_history(spark, folder))


@query
def ranges_appended(spark, folder):
    """The ranges after the history was appended in three parts, one of them twice, and compacted in between."""
    history, path = standins.ticket_history(spark, folder), new_output_dir(spark, "ranges")
    third = F.pmod("ticket_key", F.lit(3))
    for part in (0, 1, 0):
        range_store.append_history(history.where(third == part), path, f"part {part}")
    range_store.compact_history(spark, path, "first two")
    range_store.append_history(history.where(third == 2), path, "part 2")
    return range_store.stored_ranges(spark, path)


@query
def resolution_lookup(spark, folder):
    history = standins.ticket_history(spark, folder)
    found = ranges.with_range_text(ranges.resolution_lookup(history, ranges.settled_ranges(history)))
    return found.select(
        "ticket_key",
        "Priority_Level",
        "Issue_Category",
        "range_level",
        "low_hours",
        "high_hours",
        "expected_resolution_range",
        routing.department_of(F.col("Issue_Category")).alias("department"),
    )


@query
def resolution_describe(spark, folder):
    return ranges.describe_hours(standins.ticket_history(spark, folder))


@query
def stats_by_priority(spark, folder):
    return ranges.hours_by(standins.ticket_history(spark, folder), "Priority_Level")


@query
def stats_by_category(spark, folder):
    return ranges.hours_by(standins.ticket_history(spark, folder), "Issue_Category")


@query
def stats_by_channel(spark, folder):
    return ranges.hours_by(standins.ticket_history(spark, folder), "Ticket_Channel")


# Batch triage and its report


@query
def triage_batch(spark, folder):
    return triaged_text(spark, folder)


@query
def batch_results_view(spark, folder):
    return triage.batch_view(triaged_text(spark, folder))


def reported_batch(spark, folder):
    history = standins.ticket_history(spark, folder)
    return history.select(
        F.col("Priority_Level").alias("predicted_priority"),
        routing.department_of(F.col("Issue_Category")).alias("routed_department"),
    )


@query
def priority_distribution(spark, folder):
    return report.distribution(reported_batch(spark, folder), "predicted_priority")


@query
def department_distribution(spark, folder):
    return report.distribution(reported_batch(spark, folder), "routed_department")


@query
def batch_kpis(spark, folder):
    return report.batch_kpis(reported_batch(spark, folder))


@query
def priority_by_department(spark, folder):
    return report.priority_by_department(reported_batch(spark, folder))


@query
def queue_numbers(spark, folder):
    numbered = routing.with_queue_numbers(routed_queues(spark, folder))
    return numbered.select("Routed_Department", "Queue_No", "Ticket_ID")


@query
def queue_view(spark, folder):
    numbered = shown(routing.with_queue_numbers(routed_queues(spark, folder)))
    columns = [
        "Queue_No", "Ticket_ID", "Ticket_Subject", "Issue_Category", "Priority", "Expected_Resolution",
        "Ticket_Channel", "Routed_At",
    ]
    return tickets.select_available(numbered, ["Routed_Department", *columns])


# Splits, encodings and TF-IDF


@query
def stratified_split(spark, folder):
    history = standins.ticket_history(spark, folder)
    return splits.stratified_split(history, "Priority_Level", "ticket_key").select(
        "ticket_key", "Priority_Level", "split"
    )


@query
def random_split(spark, folder):
    return splits.random_split(standins.ticket_history(spark, folder), "ticket_key").select("ticket_key", "split")


@query
def split_sizes(spark, folder):
    history = standins.ticket_history(spark, folder)
    stratified = splits.stratified_split(history, "Priority_Level", "ticket_key")
    random = splits.random_split(history, "ticket_key")
    return (
        splits.split_sizes(stratified)
        .withColumn("kind", F.lit("stratified"))
        .unionByName(splits.split_sizes(random).withColumn("kind", F.lit("random")))
    )


def split_text(spark, folder):
    return splits.random_split(standins.ticket_text(spark, folder), "ticket_key")


@query
def label_mapping(spark, folder):
    return encode.label_mapping(splits.train_part(split_text(spark, folder)))


@query
def label_encode(spark, folder):
    split = split_text(spark, folder).select("ticket_key", "Priority_Level", "split")
    return encode.encode_labels(split, encode.settled_mapping(splits.train_part(split)))


@query
def label_decode(spark, folder):
    split = split_text(spark, folder).select("ticket_key", "Priority_Level", "split")
    mapping = encode.settled_mapping(splits.train_part(split))
    coded = encode.encode_labels(split, mapping).withColumn("label_code", F.coalesce("label_code", F.lit(99)))
    return encode.decode_labels(coded, mapping).select("ticket_key", "label_code", "label")


@query
def std_scale(spark, folder):
    split = splits.random_split(standins.ticket_history(spark, folder), "ticket_key")
    dated_parts = split.withColumns(dates.regression_parts(F.col("Submission_Date")))
    columns = ["submission_hour", "submission_dayofweek", "submission_month"]
    deviations = encode.population_deviations(splits.train_part(dated_parts), columns)
    scaled = encode.scale_by_deviation(dated_parts, deviations)
    return scaled.select("ticket_key", *[numbers.half_even(F.col(f"{c}_scaled"), 6).alias(c) for c in columns])


@query
def target_encode(spark, folder):
    flagged = encode.target_flags(split_text(spark, folder), "Priority_Level", PRIORITIES)
    flagged = flagged.withColumn("Ticket_Subject", text.clean_light(F.coalesce("Ticket_Subject", F.lit(""))))
    by_subject = encode.target_encode(flagged, "Ticket_Subject", {"subject_low": "is_Low"}, "ticket_key", False)
    by_category = encode.target_encode(
        by_subject, "Issue_Category", {f"category_{p.lower()}": f"is_{p}" for p in PRIORITIES}, "ticket_key", True
    )
    names = ["subject_low", *[f"category_{p.lower()}" for p in PRIORITIES]]
    return by_category.select("ticket_key", *[numbers.half_even(F.col(n), 6).alias(n) for n in names])


@query
def ordered_target_encode(spark, folder):
    """Target statistics of the training rows before each row, in a random order."""
    flagged = encode.target_flags(split_text(spark, folder), "Priority_Level", PRIORITIES)
    flagged = flagged.withColumn("Ticket_Subject", text.clean_light(F.coalesce("Ticket_Subject", F.lit(""))))
    by_subject = encode.ordered_target_encode(flagged, "Ticket_Subject", {"subject_low": "is_Low"}, "ticket_key", False)
    targets = {f"category_{p.lower()}": f"is_{p}" for p in PRIORITIES}
    by_category = encode.ordered_target_encode(by_subject, "Issue_Category", targets, "ticket_key", True)
    return by_category.select("ticket_key", *[numbers.half_even(F.col(n), 6).alias(n) for n in ["subject_low", *targets]])


def cleaned_split(spark, folder):
    split = split_text(spark, folder).select("ticket_key", "split", "Ticket_Subject", "Ticket_Description")
    empty = F.lit("")
    texts = {c: text.clean_strict(F.coalesce(c, empty)) for c in ("Ticket_Subject", "Ticket_Description")}
    return store(split.withColumns(texts), "cleaned")


@query
def vocab_topk(spark, folder):
    return tfidf.top_terms(splits.train_part(cleaned_split(spark, folder)), "Ticket_Subject", SUBJECT_TERMS)


@query
def tfidf_long(spark, folder):
    cleaned = cleaned_split(spark, folder)
    vocabulary = tfidf.fit_vocabulary(splits.train_part(cleaned), "Ticket_Description", DESCRIPTION_TERMS)
    return tfidf.tfidf_long(cleaned, "Ticket_Description", vocabulary, ["ticket_key"])


@query
def tfidf_plain_counts(spark, folder):
    cleaned = cleaned_split(spark, folder)
    settings = tfidf.TermSettings(max_terms=5000, sublinear=False, stop_words=ENGLISH_STOP_WORDS)
    vocabulary = tfidf.fit_vocabulary(splits.train_part(cleaned), "Ticket_Description", settings)
    return tfidf.tfidf_long(cleaned, "Ticket_Description", vocabulary, ["ticket_key"])


@query
def tfidf_resolution(spark, folder):
    split = split_text(spark, folder)
    combined = text.resolution_text(F.col("Ticket_Subject"), F.col("Ticket_Description"))
    texts = store(split.select("ticket_key", "split", combined.alias("text")), "texts")
    vocabulary = tfidf.fit_vocabulary(splits.train_part(texts), "text", RESOLUTION_TERMS)
    return tfidf.tfidf_long(texts, "text", vocabulary, ["ticket_key"])


@query
def preprocess_job(spark, folder):
    return preprocess(standins.ticket_text(spark, folder)).weights()


# Models, all trained with the library's defaults.

SCORED = ["ticket_key", "Priority_Level", "predicted_label"]


SAVED_MODELS: dict[tuple[str, str], str] = {}


def fitted_logistic(spark, folder):
    """Train the logistic model and save it for the queries that only score; also the scored test part."""
    model, scored = priority.train_logistic(standins.ticket_text(spark, folder), ENGLISH_STOP_WORDS)
    path = saved.save_model(model.pipeline, new_output_dir(spark, "model"))
    SAVED_MODELS[spark.sparkContext.applicationId, folder] = path
    return path, scored


def loaded_logistic(spark, folder):
    """The saved model of this session and folder, trained first if there is none."""
    path = SAVED_MODELS.get((spark.sparkContext.applicationId, folder)) or fitted_logistic(spark, folder)[0]
    return priority.PriorityModel(saved.load_model(spark, path))


@query
def one_hot(spark, folder):
    """Positions set by one-hot encoding fitted on training defaults and applied with serving defaults."""
    columns = ["Issue_Category", "Ticket_Channel"]
    split = split_text(spark, folder).select("ticket_key", "split", *columns)
    train = tickets.fill_defaults(splits.train_part(split), {c: "Unknown" for c in columns})
    stages = features.one_hot_stages(train, columns)
    labels = dict(zip(columns, stages[0].labelsArray, strict=True))
    filled = tickets.fill_defaults(split, {c: SERVING_DEFAULTS[c] for c in columns})
    encoded = PipelineModel(stages).transform(filled)
    position = F.explode_outer(F.unwrap_udt("__vector")["indices"]).alias("position")
    parts = []
    for column in columns:
        part = encoded.select("ticket_key", F.col(f"{column}_onehot").alias("__vector")).select("ticket_key", position)
        part = part.where(F.col("position").isNotNull())
        value = F.get(F.array(*[F.lit(x) for x in labels[column]]), F.col("position"))
        parts.append(part.withColumns({"feature": F.lit(column), "value": value}))
    return parts[0].unionByName(parts[1])


@query
def train_svm(spark, folder):
    return priority.train_svm(standins.ticket_text(spark, folder))[1].select(SCORED)


@query
def train_logreg(spark, folder):
    return fitted_logistic(spark, folder)[1].select(SCORED)


@query
def train_boosted(spark, folder):
    return priority.train_boosted(standins.ticket_text(spark, folder))[1].select(SCORED)


@query
def train_cat_boosted(spark, folder):
    return priority.train_categorical_boosted(standins.ticket_full(spark, folder))[1].select(SCORED)


@query
def train_ridge(spark, folder):
    return resolution.train_ridge(standins.ticket_full(spark, folder))[1]


@query
def train_forest(spark, folder):
    return resolution.train_forest(standins.ticket_history(spark, folder))[1]


@query
def confidence(spark, folder):
    model = loaded_logistic(spark, folder)
    scored = model.score(standins.ticket_text(spark, folder).select("ticket_key", *SERVING_DEFAULTS))
    return priority.confidences(scored, model.labels, ["ticket_key"])


@query
def score_batch(spark, folder):
    """Batch triage with the priority predicted by a model."""
    model = loaded_logistic(spark, folder)
    batch = tickets.complete_batch(standins.ticket_text(spark, folder).drop("Priority_Level"))
    scored = model.score(batch).drop(priority.SCORES, "prediction")
    return triage.triage_batch(scored, text_ranges(spark, folder), "predicted_label", ["ticket_key"]).drop(
        "predicted_label"
    )


@query
def model_roundtrip(spark, folder):
    """Tickets scored by a pipeline that was saved and loaded again."""
    return loaded_logistic(spark, folder).score(standins.ticket_text(spark, folder)).select("ticket_key", "predicted_label")


# Evaluation


def judged(spark, folder):
    """Labelled history with a priority guessed from the hours."""
    hours = F.col("Resolution_Time_Hours")
    guess = F.when(hours < 10, "Critical").when(hours < 40, "High").when(hours < 80, "Medium").otherwise("Low")
    return (
        standins.ticket_history(spark, folder)
        .where(F.col("Priority_Level").isNotNull())
        .select("Priority_Level", guess.alias("predicted"))
    )


@query
def confusion_matrix(spark, folder):
    return evaluate.confusion_matrix(judged(spark, folder), "Priority_Level", "predicted")


@query
def classification_report(spark, folder):
    return evaluate.classification_report(judged(spark, folder), "Priority_Level", "predicted")


@query
def accuracy(spark, folder):
    return evaluate.accuracy(judged(spark, folder), "Priority_Level", "predicted")


@query
def regression_metrics(spark, folder):
    """The middle of each ticket's expected range against its hours."""
    history = standins.ticket_history(spark, folder)
    found = ranges.resolution_lookup(history, ranges.settled_ranges(history))
    middle = numbers.clip((F.col("low_hours") + F.col("high_hours")) / 2, 0, 120)
    return evaluate.regression_metrics(found.withColumn("predicted", middle), "Resolution_Time_Hours", "predicted")


@query
def early_stop(spark, folder):
    """Stop rule on a curve of the events' mean value per day."""
    events = read_table(spark, folder, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    curve = events.groupBy(day.alias("iteration")).agg(numbers.half_even(F.avg("value"), 6).alias("loss"))
    return evaluate.early_stop(curve, "iteration", "loss", patience=5)


# Streaming


@query
def stream_routing(spark, folder):
    arriving = standins.arriving_tickets(streaming.read_stream(spark, folder, "events.parquet"))
    path = new_output_dir(spark, "stream-queues")
    routed = streaming.route_stream(
        arriving, text_ranges(spark, folder), path, new_output_dir(spark, "stream-state"), ["ticket_key"]
    )
    routed.awaitTermination()
    return shown(queues.read_queues(spark, path)).drop("ticket_md5")


@query
def stream_queue_depth(spark, folder):
    arriving = standins.arriving_tickets(streaming.read_stream(spark, folder, "events.parquet"))
    path = new_output_dir(spark, "stream-depth")
    streaming.publish_depth(streaming.live_depth(arriving), path, new_output_dir(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(path)
