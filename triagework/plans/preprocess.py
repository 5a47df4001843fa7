"""Preprocessing job: combined text, split, cleaning, TF-IDF and label codes of a ticket table."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.domain import ENGLISH_STOP_WORDS
from triagework.functions.text import clean_strict, model_text
from triagework.operators.encode import encode_labels, settled_mapping
from triagework.operators.splits import stratified_split, train_part
from triagework.operators.tfidf import (
    TermSettings,
    Vocabulary,
    fit_vocabulary,
    tfidf_long,
    with_weights,
)
from triagework.session import store
from triagework.sources.exports import write_parquet
from triagework.sources.tickets import require_columns

REQUIRED = ["Ticket_Description", "Ticket_Subject", "Issue_Category", "Priority_Level"]
MAX_TERMS = 5000
MIN_DOCUMENTS = 2
VOCABULARY_SCHEMA = (
    "terms array<string>, idf array<double>, max_terms int, min_documents int, sublinear boolean, "
    "stop_words array<string>"
)


@dataclass(frozen=True)
class Preprocessed:
    """Cleaned and split texts with label codes, the fitted vocabulary and the label numbering."""

    texts: DataFrame
    vocabulary: Vocabulary
    labels: DataFrame

    def weights(self) -> DataFrame:
        """One row per ticket and term."""
        return tfidf_long(self.texts, "model_text", self.vocabulary, ["ticket_key", "split", "label_code"])

    def sparse_rows(self) -> DataFrame:
        """One row per ticket with its term positions and weights as arrays."""
        weighed = with_weights(self.texts, "model_text", self.vocabulary)
        return weighed.select("ticket_key", "split", "label_code", "indices", "weights")


def preprocess(tickets: DataFrame, key: str = "ticket_key", stop_words: tuple[str, ...] | None = None) -> Preprocessed:
    """Split before cleaning, and fit vocabulary and labels on the training part only.

    Tickets without a priority cannot be stratified or trained on and are left out.
    """
    require_columns(tickets, REQUIRED)
    words = ENGLISH_STOP_WORDS if stop_words is None else stop_words
    settings = TermSettings(MAX_TERMS, MIN_DOCUMENTS, True, words)
    labelled = tickets.where(F.col("Priority_Level").isNotNull())
    text = model_text(F.col("Issue_Category"), F.col("Ticket_Subject"), F.col("Ticket_Description"))
    combined = labelled.select(F.col(key).alias("ticket_key"), "Priority_Level", text.alias("model_text"))
    split = stratified_split(combined, "Priority_Level", "ticket_key")
    cleaned = store(split.withColumn("model_text", clean_strict(F.col("model_text"))), "cleaned")
    labels = settled_mapping(train_part(cleaned))
    texts = encode_labels(cleaned, labels)
    return Preprocessed(texts, fit_vocabulary(train_part(cleaned), "model_text", settings), labels)


def write_preprocessed(result: Preprocessed, folder: str) -> str:
    """Sparse feature rows, the long TF-IDF table, labels, and what was fitted: vocabulary and label numbering."""
    write_parquet(result.sparse_rows(), f"{folder}/features")
    write_parquet(result.weights(), f"{folder}/tfidf")
    write_parquet(result.texts.select("ticket_key", "split", "label_code"), f"{folder}/labels")
    write_parquet(result.labels, f"{folder}/label_mapping")
    write_vocabulary(result.texts.sparkSession, result.vocabulary, f"{folder}/vocabulary")
    return folder


def write_vocabulary(spark: SparkSession, vocabulary: Vocabulary, path: str) -> str:
    """The fitted vectoriser as a table of one row: its settings, and its terms with their inverse document frequency."""
    settings = vocabulary.settings
    row = (
        vocabulary.terms, vocabulary.idf, settings.max_terms, settings.min_documents, settings.sublinear,
        list(settings.stop_words),
    )
    return write_parquet(spark.createDataFrame([row], VOCABULARY_SCHEMA), path)


def read_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    row = spark.read.parquet(path).first()
    settings = TermSettings(row.max_terms, row.min_documents, row.sublinear, tuple(row.stop_words))
    return Vocabulary(row.terms, row.idf, settings)


def transform_texts(tickets: DataFrame, vocabulary: Vocabulary, key: str = "ticket_key") -> DataFrame:
    """Term positions and weights of new tickets under a fitted vocabulary."""
    text = model_text(F.col("Issue_Category"), F.col("Ticket_Subject"), F.col("Ticket_Description"))
    cleaned = tickets.select(key, clean_strict(text).alias("model_text"))
    return with_weights(cleaned, "model_text", vocabulary).select(key, "indices", "weights")
