"""From raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs`` and only drop rows:

1. quality: documents outside the importance sample go (labels of ``sf_dir`` train it);
2. language: documents whose language is unknown or ambiguous go;
3. exact copies: of texts equal after lowering A-Z, the one with the largest doc_id stays;
4. near copies: of each component of SimHash fingerprints (4-word shingles, 4 bits), the smallest doc_id stays;
5. packing: the pieces of what is left, placed in sequences of at most 4,096 tokens.

No rows give no rows. What each stage does with nulls, empty texts and repeated rows is told in its module.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from triagework.llm.common import crc_fold, read_table, scratch
from triagework.llm.exact_dedup import drop_exact_copies
from triagework.llm.language import keep_known
from triagework.llm.packing import pack_documents
from triagework.llm.quality import is_target, keep_good
from triagework.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, read_table(spark, sf_dir, "labels"), is_target())


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known(docs, crc_fold("doc_id", 3) != 1)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("packing", packing),
]

#: SQL cannot express the classifiers, the components and the packing; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
