"""Resolution-time regressors."""

from pyspark.ml import PipelineModel
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagework.functions.dates import regression_parts
from triagework.functions.text import resolution_text
from triagework.models.cells import fit_cell_forest
from triagework.models.features import one_hot_stages, tfidf_stages
from triagework.models.stages import ClippedHours
from triagework.operators.encode import population_deviations
from triagework.operators.splits import random_split, test_part, train_part
from triagework.operators.tfidf import TermSettings, fit_vocabulary
from triagework.session import store
from triagework.sources.tickets import drop_incomplete, require_columns

HOURS = "Resolution_Time_Hours"
CATEGORIES = ["Issue_Category", "Priority_Level", "Ticket_Channel"]
DATE_PARTS = ["submission_hour", "submission_dayofweek", "submission_month"]
REQUIRED = ["Ticket_Subject", "Ticket_Description", *CATEGORIES, "Submission_Date", HOURS]
TEXT = TermSettings(max_terms=5000)


def regression_inputs(tickets: DataFrame, key: str) -> DataFrame:
    """Combined raw text, filled categories, date parts and hours of the tickets whose hours are known."""
    require_columns(tickets, REQUIRED)
    return tickets.where(F.col(HOURS).isNotNull()).select(
        key,
        resolution_text(F.col("Ticket_Subject"), F.col("Ticket_Description")).alias("text"),
        *[F.coalesce(c, F.lit("Unknown")).alias(c) for c in CATEGORIES],
        *[c.cast("double").alias(n) for n, c in regression_parts(F.col("Submission_Date")).items()],
        F.col(HOURS).cast("double").alias(HOURS),
    )


def ridge_penalty(alpha: float, deviation: float, rows: int) -> float:
    """Spark averages the squared error and divides the target by its deviation; this undoes both."""
    return alpha * deviation / rows


def train_ridge(
    tickets: DataFrame,
    alpha: float = 30.0,
    iterations: int = 100,
    tolerance: float = 1e-9,
    key: str = "ticket_key",
) -> tuple[PipelineModel, DataFrame]:
    """Ridge regression of ``log1p`` hours; predictions are turned back and clipped to 0..120 hours."""
    inputs = store(random_split(regression_inputs(tickets, key), key), "regression-inputs")
    train = train_part(inputs)
    deviations = population_deviations(train, DATE_PARTS)
    stages = [
        *tfidf_stages("text", fit_vocabulary(train, "text", TEXT)),
        *one_hot_stages(train, CATEGORIES),
        VectorAssembler(inputCols=DATE_PARTS, outputCol="dates"),
        ElementwiseProduct(
            scalingVec=Vectors.dense([1.0 / deviations[c] for c in DATE_PARTS]), inputCol="dates", outputCol="scaled"
        ),
        VectorAssembler(inputCols=["text_tfidf", *[f"{c}_onehot" for c in CATEGORIES], "scaled"], outputCol="features"),
    ]
    log_hours = F.log1p(HOURS).alias("log_hours")
    features = store(PipelineModel(stages).transform(train).select("features", log_hours), "features")
    spread, rows = features.agg(F.stddev_samp("log_hours"), F.count(F.lit(1))).first()
    ridge = LinearRegression(
        labelCol="log_hours",
        predictionCol="predicted_log",
        regParam=ridge_penalty(alpha, spread, rows),
        elasticNetParam=0.0,
        standardization=False,
        solver="l-bfgs",
        maxIter=iterations,
        tol=tolerance,
    ).fit(features)
    back = ClippedHours(inputCol="predicted_log", outputCol="predicted_hours", low=0.0, high=120.0, logged=True)
    pipeline = PipelineModel([*stages, ridge, back])
    return pipeline, pipeline.transform(test_part(inputs)).select(key, HOURS, "predicted_hours")


def train_forest(
    tickets: DataFrame,
    trees: int = 300,
    depth: int = 12,
    min_rows: int = 5,
    seed: int = 42,
    key: str = "ticket_key",
) -> tuple[PipelineModel, DataFrame]:
    """Random forest of the hours on three categories, grown on their cells; predictions are clipped to 1..120 hours."""
    columns = [CATEGORIES[1], CATEGORIES[0], CATEGORIES[2]]
    complete = drop_incomplete(tickets.select(key, *columns, HOURS), [*columns, HOURS])
    split = store(random_split(complete, key), "forest-rows")
    train = train_part(split)
    forest = fit_cell_forest(
        train.withColumn(HOURS, F.col(HOURS).cast("double")), key, columns, HOURS, trees, depth, min_rows, seed
    )
    clipped = ClippedHours(inputCol="predicted_raw", outputCol="predicted_hours", low=1.0, high=120.0)
    pipeline = PipelineModel([forest, clipped])
    return pipeline, pipeline.transform(test_part(split)).select(key, HOURS, "predicted_hours")
