"""Pipeline stages Spark ML does not ship; they save and load with the pipeline that holds them."""

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from triagework.operators.tfidf import with_terms


def _log_counts(counts: Column) -> Column:
    """``1 + ln(count)`` of a sparse vector's values; a vector is made of a row of plain columns by reading it as JSON."""
    parts = F.unwrap_udt(counts)
    logs = F.transform(parts["values"], lambda n: F.ln(n) + 1.0)
    row = F.struct(*[parts[p].alias(p) for p in ("type", "size", "indices")], logs.alias("values"))
    schema = StructType([StructField("vector", VectorUDT())])
    return F.from_json(F.to_json(F.struct(row.alias("vector"))), schema)["vector"]


class TextTerms(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Words and word pairs of a text, without ``stopWords``."""

    stopWords = Param(Params._dummy(), "stopWords", "words to leave out", TypeConverters.toListString)

    @keyword_only
    def __init__(
        self, *, inputCol: str | None = None, outputCol: str | None = None, stopWords: list[str] | None = None
    ):
        super().__init__()
        self._setDefault(stopWords=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return with_terms(dataset, self.getInputCol(), self.getOrDefault(self.stopWords), self.getOutputCol())


class LogCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Replace the non-zero counts of a sparse vector by ``1 + ln(count)``."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), _log_counts(F.col(self.getInputCol())))


class LabelOfPrediction(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Add ``predicted_label`` and the probabilities of a multi-class model as an array ``outputCol``."""

    labels = Param(Params._dummy(), "labels", "class labels", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, outputCol: str | None = None, labels: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = dataset.withColumn(self.getOutputCol(), vector_to_array(F.col("probability")))
        return with_label(scored, self.getOrDefault(self.labels))


class ClippedHours(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Predicted hours within bounds; ``logged`` predictions are turned back by ``expm1`` first."""

    low = Param(Params._dummy(), "low", "smallest hours", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "largest hours", TypeConverters.toFloat)
    logged = Param(Params._dummy(), "logged", "input is log1p of hours", TypeConverters.toBoolean)

    @keyword_only
    def __init__(
        self,
        *,
        inputCol: str | None = None,
        outputCol: str | None = None,
        low: float = 0.0,
        high: float = 120.0,
        logged: bool = False,
    ):
        super().__init__()
        self._setDefault(low=0.0, high=120.0, logged=False)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        value = F.col(self.getInputCol())
        value = F.expm1(value) if self.getOrDefault(self.logged) else value
        low, high = F.lit(self.getOrDefault(self.low)), F.lit(self.getOrDefault(self.high))
        return dataset.withColumn(self.getOutputCol(), F.greatest(low, F.least(high, value)))


def with_label(scored: DataFrame, labels: list[str]) -> DataFrame:
    names = F.array(*[F.lit(x) for x in labels])
    number = F.col("prediction").cast("int")
    return scored.withColumn("predicted_label", F.coalesce(F.get(names, number), number.cast("string")))
