"""Saving and loading fitted pipelines."""

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from triagework.sources.tickets import path_exists


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    """The saved pipeline, or None when there is none at ``path``."""
    return PipelineModel.load(path) if path_exists(spark, path) else None


def missing_models(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """Names whose model is not there yet; nothing can be scored until the list is empty."""
    return [name for name, path in paths.items() if not path_exists(spark, path)]
