"""Registered queries of this subpackage and their SQL counterparts."""

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from triagework.llm.byte_bpe import op9_byte_bpe
from triagework.llm.class_lm import op2_class_lm
from triagework.llm.ego_join import OP3_SQL, op3_ego_join
from triagework.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from triagework.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from triagework.llm.language import op6_language
from triagework.llm.packing import op4_pack
from triagework.llm.periodic_runs import op11_periodic_runs
from triagework.llm.quality import op5_quality
from triagework.llm.rank_bpe import op12_rank_bpe
from triagework.llm.sharding import op8_sharding
from triagework.llm.simhash import op1_simhash
from triagework.llm.url_rules import op10_url_rules

Query = Callable[[SparkSession, str], DataFrame]


def with_package(query: Query) -> Query:
    """Let Python workers find this package where the driver does, also if only the driver's path was extended."""
    root = str(Path(__file__).resolve().parents[2])

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        environment = spark.sparkContext.environment
        paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_class_lm": op2_class_lm,
    "op3_ego_join": op3_ego_join,
    "op4_pack": op4_pack,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sharding": op8_sharding,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_url_rules": op10_url_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_rank_bpe": op12_rank_bpe,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}
QUERIES = {name: with_package(query) for name, query in QUERIES.items()}

STATEMENTS = {"op3_ego_join": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op13_hard_negatives": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    STATEMENTS["pipeline"] = corpus_pipeline.ORACLE_SQL
