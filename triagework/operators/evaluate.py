"""Evaluation of classifiers, regressors and training curves."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagework.domain import PRIORITIES
from triagework.functions.numbers import half_even


def label_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: list[str] = PRIORITIES) -> DataFrame:
    """One row per actual label, one count column per predicted label, 0 where nothing was counted."""
    frame = _label_frame(df, labels).withColumnRenamed("label", "actual")
    counts = (
        label_counts(df, actual, predicted)
        .groupBy("actual")
        .pivot("predicted", labels)
        .agg(F.sum("n"))
    )
    return frame.join(counts, "actual", "left").na.fill(0, labels).orderBy("actual")


def classification_report(
    df: DataFrame, actual: str, predicted: str, labels: list[str] = PRIORITIES, digits: int = 6
) -> DataFrame:
    """Precision, recall, f1 and support per label, and their accuracy, macro and weighted average lines."""
    counts = label_counts(df, actual, predicted)
    none = F.lit(0).cast("long")
    sides = counts.select(
        F.inline(
            F.array(
                _side("actual", support=F.col("n"), found=none),
                _side("predicted", support=none, found=F.col("n")),
            )
        ),
        F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(none).alias("hit"),
    )
    # Each pair is listed on its actual and on its predicted side, so a hit is counted twice.
    per_label = sides.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("found").alias("found"), (F.sum("hit") / 2).alias("hits")
    )
    zero = F.lit(0.0)
    scored = (
        _label_frame(df, labels)
        .join(per_label, "label", "left")
        .na.fill(0, ["support", "found", "hits"])
        .withColumns({"precision": _ratio("hits", "found"), "recall": _ratio("hits", "support")})
        .withColumn(
            "f1",
            F.coalesce(
                F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero
            ),
        )
    )
    scores = ["precision", "recall", "f1"]
    total = F.sum("support")
    averages = scored.agg(
        F.coalesce(F.try_divide(F.sum("hits"), total), zero).alias("accuracy"),
        total.alias("support"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[
            F.coalesce(F.try_divide(F.sum(F.col(s) * F.col("support")), total), zero).alias(f"weighted_{s}")
            for s in scores
        ],
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit("accuracy").alias("label"), *[F.col("accuracy").alias(s) for s in scores], "support"),
                F.struct(F.lit("macro avg").alias("label"), *[F.col(f"macro_{s}").alias(s) for s in scores], "support"),
                F.struct(
                    F.lit("weighted avg").alias("label"), *[F.col(f"weighted_{s}").alias(s) for s in scores], "support"
                ),
            )
        )
    )
    lines = scored.select("label", *scores, "support").unionByName(averages)
    return lines.select("label", *[half_even(F.col(s), digits).alias(s) for s in scores], "support")


def _side(label: str, support: Column, found: Column) -> Column:
    return F.struct(F.col(label).alias("label"), support.alias("support"), found.alias("found"))


def _ratio(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def _label_frame(df: DataFrame, labels: list[str]) -> DataFrame:
    rows = ", ".join("('" + x.replace("'", "''") + "')" for x in labels)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(label)")


def accuracy(df: DataFrame, actual: str, predicted: str, digits: int = 4) -> DataFrame:
    hit = F.coalesce((F.col(actual) == F.col(predicted)).cast("int"), F.lit(0))
    return df.agg(half_even(F.avg(hit), digits).alias("accuracy"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, digits: int = 6) -> DataFrame:
    """Mean absolute error, root mean squared error and R² over rows with both values, in one pass."""
    error = F.col(actual) - F.col(predicted)
    known = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    squares = F.sum(error * error)
    spread = F.var_pop(actual) * F.count(F.lit(1))
    return known.agg(
        F.count(F.lit(1)).alias("rows"),
        half_even(F.avg(F.abs(error)), digits).alias("mae"),
        half_even(F.sqrt(F.avg(error * error)), digits).alias("rmse"),
        half_even(1 - F.try_divide(squares, spread), digits).alias("r2"),
    )


def early_stop(curve: DataFrame, iteration: str, loss: str, patience: int) -> DataFrame:
    """Where training stops on an evaluation curve: ``patience`` rounds after the last new minimum, or at its end.

    The curve has one row per training round, so it is small however large the data is.
    """
    so_far = Window.orderBy(iteration).rowsBetween(Window.unboundedPreceding, 0)
    best = F.min(F.struct(F.col(loss).alias("loss"), F.col(iteration).alias("iteration"))).over(so_far)
    marked = curve.where(F.col(loss).isNotNull()).select(F.col(iteration).alias("iteration"), best.alias("best"))
    over = F.col("iteration") - F.col("best.iteration") >= patience
    stop = marked.agg(
        F.min(F.when(over, F.struct("iteration", "best"))).alias("stopped"),
        F.max(F.struct("iteration", "best")).alias("last"),
    ).select(F.coalesce("stopped", "last").alias("end"), F.col("stopped").isNotNull().alias("stopped_early"))
    return stop.select(
        F.col("end.iteration").alias("stop_iteration"),
        F.col("end.best.iteration").alias("best_iteration"),
        F.col("end.best.loss").alias("best_loss"),
        "stopped_early",
    )
