"""Model inputs of tickets, and the fitted stages that turn them into feature vectors."""

from pyspark.ml import Transformer
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    OneHotEncoder,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagework.functions.text import clean_strict, strict_statistics
from triagework.models.stages import LogCounts, TextTerms
from triagework.operators.tfidf import TermSettings, Vocabulary, fit_vocabulary
from triagework.sources.tickets import fill_defaults

SUBJECT_TERMS = TermSettings(max_terms=2500, min_documents=2)
DESCRIPTION_TERMS = TermSettings(max_terms=7500, min_documents=2)
TEXTS = ["Ticket_Subject", "Ticket_Description"]
CATEGORICAL = ["Issue_Category", "Ticket_Channel"]
STATISTICS = [
    "Subject_Length", "Description_Length", "Subject_Word_Count", "Description_Word_Count", "Exclamation_Count",
    "Question_Count", "Problem_Word_Count",
]


def priority_inputs(tickets: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Filled and strictly cleaned texts, filled categories and the seven text statistics.

    Model inputs are separate columns ``model_*``, so the ticket keeps its columns as they came.
    """
    columns = [*TEXTS, *CATEGORICAL]
    filled = fill_defaults(tickets.select("*", *[F.col(c).alias(f"model_{c}") for c in columns]), {
        f"model_{c}": defaults[c] for c in columns
    })
    cleaned = filled.withColumns({f"model_{c}": clean_strict(F.col(f"model_{c}")) for c in TEXTS})
    statistics = strict_statistics(F.col("model_Ticket_Subject"), F.col("model_Ticket_Description"))
    return cleaned.withColumns({f"model_{n}": c.cast("double") for n, c in statistics.items()})


def tfidf_stages(text: str, vocabulary: Vocabulary) -> list[Transformer]:
    """Stages from a text column to its unit-length weights ``<text>_tfidf``."""
    stages: list[Transformer] = [
        TextTerms(inputCol=text, outputCol=f"{text}_terms", stopWords=list(vocabulary.settings.stop_words)),
        CountVectorizerModel.from_vocabulary(vocabulary.terms, f"{text}_terms", f"{text}_counts"),
    ]
    last = f"{text}_counts"
    if vocabulary.settings.sublinear:
        stages.append(LogCounts(inputCol=last, outputCol=f"{text}_logs"))
        last = f"{text}_logs"
    idf = ElementwiseProduct(scalingVec=Vectors.dense(vocabulary.idf), inputCol=last, outputCol=f"{text}_idf")
    return [*stages, idf, Normalizer(p=2.0, inputCol=f"{text}_idf", outputCol=f"{text}_tfidf")]


def one_hot_stages(train: DataFrame, columns: list[str]) -> list[Transformer]:
    """Fitted one-hot stages ``<column>_onehot``; values not seen in training become all zeros."""
    indexer = StringIndexer(
        inputCols=columns,
        outputCols=[f"{c}_index" for c in columns],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    ).fit(train)
    # The indexer gives unseen values one index past the labels; dropping that last position leaves them all zeros.
    encoder = OneHotEncoder(
        inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_onehot" for c in columns], dropLast=True
    )
    return [indexer, encoder.fit(indexer.transform(train))]


def feature_stages(
    train: DataFrame, texts: dict[str, TermSettings], categorical: list[str], numeric: list[str]
) -> list[Transformer]:
    """Stages fitted on ``train`` that assemble ``features``: texts, then categories, then numbers."""
    stages: list[Transformer] = []
    for text, settings in texts.items():
        stages += tfidf_stages(text, fit_vocabulary(train, text, settings))
    if categorical:
        stages += one_hot_stages(train, categorical)
    inputs = [*[f"{t}_tfidf" for t in texts], *[f"{c}_onehot" for c in categorical], *numeric]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]
