"""Ticket tables derived from the test tables, which hold no tickets of their own.

Orders with their customers play the ticket history, documents with their labels the ticket texts, pages the tickets
with markup, conversations the ticket threads and events the arriving tickets.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.sources.tables import read_table, spread


def _choose(value: Column, choices: dict, default: str | None = None) -> Column:
    result = F
    for key, label in choices.items():
        result = result.when(value == key, label)
    return result.otherwise(default)


def ticket_history(spark: SparkSession, folder: str) -> DataFrame:
    """One ticket per order: null priorities and hours, and a rare category for the small-group fallback."""
    orders = read_table(spark, folder, "orders")
    customers = read_table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    segments = {"AUTOMOBILE": "Technical", "BUILDING": "Billing", "MACHINERY": "Fraud", "HOUSEHOLD": "Account"}
    category = _choose(F.col("c_mktsegment"), segments, "General Inquiry")
    priorities = {"1-URGENT": "Critical", "2-HIGH": "High", "3-MEDIUM": "Medium", "5-LOW": "Low"}
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("ticket_key"),
        F.when(F.col("o_orderkey") % 1000 == 0, "Security").otherwise(category).alias("Issue_Category"),
        _choose(F.col("o_orderstatus"), {"O": "Chat", "F": "Email"}, "Web Form").alias("Ticket_Channel"),
        _choose(F.col("o_orderpriority"), priorities).alias("Priority_Level"),
        F.col("o_orderdate").cast("timestamp").alias("Submission_Date"),
        F.when(F.col("o_orderkey") % 50 != 7, F.col("o_totalprice") % 120).alias("Resolution_Time_Hours"),
    )


def ticket_text(spark: SparkSession, folder: str) -> DataFrame:
    """One ticket per document: null subjects and channels, a category routing does not know, partial priorities.

    The whole text is both subject and description.
    """
    return _text_tickets(spark, folder)


def _text_tickets(spark: SparkSession, folder: str, **more: Column) -> DataFrame:
    documents = spread(read_table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    labels = read_table(spark, folder, "labels")
    source = F.pmod(F.substring("source", 4, 10).cast("int"), F.lit(7))
    categories = {0: "Technical", 1: "Billing", 2: "Fraud", 3: "Account", 4: "General Inquiry", 5: "Other"}
    quality, toxic = F.col("quality"), F.col("toxic") == 1
    priority = (
        F.when((quality == 0) & toxic, "Critical")
        .when(quality == 0, "High")
        .when((quality == 1) & toxic, "Medium")
        .when(quality == 1, "Low")
    )
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("ticket_key"),
        F.when(F.col("doc_id") % 10 != 3, F.col("text")).alias("Ticket_Subject"),
        F.col("text").alias("Ticket_Description"),
        _choose(source, categories).alias("Issue_Category"),
        _choose(F.col("lang"), {"en": "Email", "fr": "Chat", "de": "Web Form"}).alias("Ticket_Channel"),
        priority.alias("Priority_Level"),
        *[column.alias(name) for name, column in more.items()],
    )


def ticket_full(spark: SparkSession, folder: str) -> DataFrame:
    """Ticket texts of all documents with a submission date from their number and hours from their length."""
    submitted = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 3_600)
    hours = F.pmod(F.col("n_chars"), F.lit(1_200)) / 10
    return _text_tickets(spark, folder, Submission_Date=submitted, Resolution_Time_Hours=hours)


def ticket_html(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "pages")).select(
        F.col("page_id").alias("ticket_key"),
        F.col("html").alias("Ticket_Description"),
        F.col("url").alias("Ticket_Subject"),
    )


def ticket_thread(spark: SparkSession, folder: str) -> DataFrame:
    """The first user turn of each conversation; combined before the shuffle, so long threads do no harm."""
    turns = read_table(spark, folder, "conversations").where(F.col("role") == "user")
    first = F.min(F.struct("turn", "text"))
    return turns.groupBy(F.col("conv_id").alias("ticket_key")).agg(first["text"].alias("Ticket_Description"))


EVENT_CATEGORIES = {
    "error": "Technical",
    "purchase": "Billing",
    "signup": "Account",
    "view": "General Inquiry",
    "click": "Fraud",
}
EVENT_PRIORITIES = {"error": "Critical", "purchase": "High", "signup": "Medium", "view": "Low"}


def arriving_tickets(events: DataFrame) -> DataFrame:
    """Tickets of a batch or stream of events, arriving at the event's second."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("ticket_key"),
        kind.alias("Ticket_Subject"),
        F.col("props").alias("Ticket_Description"),
        _choose(kind, EVENT_CATEGORIES).alias("Issue_Category"),
        F.lit("Web Form").alias("Ticket_Channel"),
        _choose(kind, EVENT_PRIORITIES).alias("Priority_Level"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("Arrived_At"),
        F.col("value").alias("hours"),
    )
