"""Priority classifiers, fitted on feature vectors that were computed and stored once; all classes are learned at once."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.domain import SERVING_DEFAULTS, TRAINING_DEFAULTS
from triagework.functions.dates import calendar_parts
from triagework.functions.numbers import half_even
from triagework.functions.text import clean_light, light_statistics
from triagework.models.boosting import BoostSettings, SoftmaxTrees, boost
from triagework.models.features import (
    CATEGORICAL,
    DESCRIPTION_TERMS,
    STATISTICS,
    SUBJECT_TERMS,
    TEXTS,
    feature_stages,
    priority_inputs,
)
from triagework.models.stages import LabelOfPrediction
from triagework.models.svm import LinearScores, fit_machines
from triagework.operators.encode import ordered_target_encode, target_flags
from triagework.operators.splits import stratified_split, test_part, train_part
from triagework.operators.tfidf import TermSettings
from triagework.session import store
from triagework.sources.exports import write_parquet
from triagework.sources.tickets import fill_defaults, path_exists, require_columns

LABEL = "Priority_Level"
SCORES = "class_scores"
REQUIRED = [*TEXTS, *CATEGORICAL, LABEL]

Learner = Callable[[DataFrame, list[str]], list[Transformer]]


@dataclass(frozen=True)
class PriorityModel:
    """A fitted pipeline from the ``model_*`` columns to scores; all it needs is saved with the pipeline."""

    pipeline: PipelineModel

    @property
    def labels(self) -> list[str]:
        last = self.pipeline.stages[-1]
        return last.getOrDefault(last.labels)

    def score(self, tickets: DataFrame, defaults: dict[str, str] = SERVING_DEFAULTS) -> DataFrame:
        """Tickets with ``class_scores``, ``prediction`` and ``predicted_label``."""
        return self.score_inputs(priority_inputs(tickets, defaults), tickets.columns)

    def score_inputs(self, inputs: DataFrame, keep: list[str]) -> DataFrame:
        return self.pipeline.transform(inputs).select(*keep, SCORES, "prediction", "predicted_label")


def fit_priority(
    tickets: DataFrame,
    learner: Learner,
    texts: dict[str, TermSettings] | None = None,
    categorical: list[str] | None = None,
    numeric: list[str] | None = None,
    key: str = "ticket_key",
) -> tuple[PriorityModel, DataFrame]:
    """Split the labelled tickets, fit on the training part and score the test part.

    Everything fitted sees the training part only.
    """
    require_columns(tickets, REQUIRED)
    texts = {f"model_{TEXTS[0]}": SUBJECT_TERMS, f"model_{TEXTS[1]}": DESCRIPTION_TERMS} if texts is None else texts
    categorical = [f"model_{c}" for c in CATEGORICAL] if categorical is None else categorical
    numeric = [f"model_{c}" for c in STATISTICS] if numeric is None else numeric
    labelled = tickets.where(F.col(LABEL).isNotNull())
    split = stratified_split(labelled, LABEL, key)
    inputs = store(
        priority_inputs(split, TRAINING_DEFAULTS).select(key, LABEL, "split", *texts, *categorical, *numeric),
        "priority-inputs",
    )
    train = train_part(inputs)
    labels = [row[0] for row in train.select(LABEL).distinct().orderBy(LABEL).collect()]
    stages = feature_stages(train, texts, categorical, numeric)
    features = PipelineModel(stages).transform(train).select(F.col(key).alias("row_key"), LABEL, "features")
    pipeline = PipelineModel([*stages, *learner(store(features, "features"), labels)])
    model = PriorityModel(pipeline)
    return model, model.score_inputs(test_part(inputs), [key, LABEL])


def boosted_learner(
    rounds: int = 300,
    depth: int = 6,
    step: float = 0.05,
    row_share: float = 0.8,
    feature_share: float = 0.8,
    min_hessian: float = 3.0,
    l2: float = 1.0,
    bins: int = 256,
    seed: int = 42,
    path: str | None = None,
) -> Learner:
    """Soft-max boosted trees of all classes at once; ``path`` keeps the state of a training that may have to go on."""
    settings = BoostSettings(rounds, depth, step, row_share, feature_share, min_hessian, l2, bins, seed)

    def learn(train: DataFrame, labels: list[str]) -> list[Transformer]:
        found = boost(train, class_number(labels), len(labels), vector_width(train), settings, "row_key", path=path)
        return [SoftmaxTrees.of(found, labels, depth, "features", SCORES)]

    return learn


def class_number(labels: list[str]) -> Column:
    """Place of a row's label among the labels, null for a label that is none of them."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(LABEL))
    return F.when(place > 0, place - 1)


def vector_width(rows: DataFrame, features: str = "features") -> int:
    parts = F.unwrap_udt(features)
    first = rows.select(F.coalesce(parts["size"], F.size(parts["values"]))).first()
    return first[0] if first else 0


def svm_learner(c: float = 1.0, tolerance: float = 1e-4, iterations: int = 100) -> Learner:
    """Linear support vector machines with the squared hinge, one per class, with balanced costs; scores are margins.

    Of a class's machine only its own rows are weighted.
    """

    def learn(train: DataFrame, labels: list[str]) -> list[Transformer]:
        counts = {row[LABEL]: row["count"] for row in train.groupBy(LABEL).count().collect()}
        rows = sum(counts.values())
        costs = [c * rows / (len(labels) * counts[label]) for label in labels]
        found = fit_machines(train, class_number(labels), costs, vector_width(train), c, tolerance, iterations)
        return [LinearScores(inputCol="features", outputCol=SCORES, labels=labels, weights=found.ravel().tolist())]

    return learn


def logistic_learner(iterations: int = 1000, c: float = 1.0) -> Learner:
    """One multinomial logistic regression with the penalty ``1 / (c * rows)``."""

    def learn(train: DataFrame, labels: list[str]) -> list[Transformer]:
        regression = LogisticRegression(
            family="multinomial",
            labelCol="label_code",
            maxIter=iterations,
            regParam=1.0 / (c * train.count()),
            elasticNetParam=0.0,
            standardization=False,
        )
        fitted = regression.fit(train.withColumn("label_code", class_number(labels).cast("double")))
        return [fitted, LabelOfPrediction(outputCol=SCORES, labels=labels)]

    return learn


def train_boosted(tickets: DataFrame, learner: Learner | None = None, **options) -> tuple[PriorityModel, DataFrame]:
    """Boosted trees on TF-IDF of both texts, categories and text statistics."""
    return fit_priority(tickets, learner or boosted_learner(), **options)


def train_svm(tickets: DataFrame, learner: Learner | None = None) -> tuple[PriorityModel, DataFrame]:
    """Support vector machines on TF-IDF of both texts and categories."""
    return fit_priority(tickets, learner or svm_learner(), numeric=[])


def train_logistic(
    tickets: DataFrame, stop_words: tuple[str, ...], learner: Learner | None = None
) -> tuple[PriorityModel, DataFrame]:
    """Logistic regression on plain TF-IDF of the description."""
    texts = {"model_Ticket_Description": TermSettings(5000, 1, False, stop_words)}
    return fit_priority(tickets, learner or logistic_learner(), texts=texts, categorical=[], numeric=[])


LIGHT_NUMBERS = [
    "Submission_Year", "Submission_Month", "Submission_Day", "Submission_DayOfWeek", "Submission_Hour",
    "Subject_Length", "Description_Length", "Subject_Word_Count", "Description_Word_Count", "Exclamation_Count",
    "Question_Count", "Urgency_Word_Count",
]
CATEGORY_COLUMNS = [*TEXTS, *CATEGORICAL]


def categorical_inputs(tickets: DataFrame, defaults: dict[str, str] = TRAINING_DEFAULTS) -> DataFrame:
    """Tickets plus ``model_*`` columns: lightly cleaned texts, filled categories, date parts and text statistics."""
    names = {c: f"model_{c}" for c in CATEGORY_COLUMNS}
    filled = fill_defaults(
        tickets.select("*", *[F.col(c).alias(n) for c, n in names.items()]), {n: defaults[c] for c, n in names.items()}
    )
    cleaned = filled.withColumns({names[c]: clean_light(F.col(names[c])) for c in TEXTS})
    submitted = F.col("Submission_Date") if "Submission_Date" in tickets.columns else F.lit(None).cast("timestamp")
    numbers = {
        **calendar_parts(submitted),
        **light_statistics(F.col(names["Ticket_Subject"]), F.col(names["Ticket_Description"])),
    }
    return cleaned.withColumns({f"model_{n}": c.cast("double") for n, c in numbers.items()})


@dataclass(frozen=True)
class CategoricalBoosting:
    """Boosted trees over target-encoded columns: encodings, one pipeline, and where training stopped.

    ``encodings`` is a table of the training rows' counts per category column, category and class. ``curve`` has the loss
    of the watched part after every round that was run, ``rounds`` of which were kept.
    """

    encodings: DataFrame
    pipeline: PipelineModel
    rounds: int = 0
    curve: tuple[float, ...] = ()

    @property
    def labels(self) -> list[str]:
        last = self.pipeline.stages[-1]
        return last.getOrDefault(last.labels)

    def score(self, tickets: DataFrame, defaults: dict[str, str] = SERVING_DEFAULTS) -> DataFrame:
        """Tickets with ``class_scores``, ``prediction`` and ``predicted_label``."""
        inputs = encode_with(categorical_inputs(tickets, defaults), self.encodings, len(self.labels))
        return self.pipeline.transform(inputs).select(*tickets.columns, SCORES, "prediction", "predicted_label")

    def save(self, path: str) -> str:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        write_parquet(self.encodings, f"{path}/encodings")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "CategoricalBoosting | None":
        if not path_exists(spark, f"{path}/pipeline"):
            return None
        return CategoricalBoosting(
            spark.read.parquet(f"{path}/encodings"), PipelineModel.load(f"{path}/pipeline")
        )


def train_categorical_boosted(
    tickets: DataFrame,
    rounds: int = 500,
    depth: int = 7,
    step: float = 0.05,
    l2: float = 5.0,
    bins: int = 255,
    patience: int = 50,
    seed: int = 42,
    key: str = "ticket_key",
    validation: str = "test",
    path: str | None = None,
) -> tuple[CategoricalBoosting, DataFrame]:
    """Boosted trees that take the texts themselves as categories, stopped early on the part named ``validation``.

    Every category column becomes one ordered target statistic per class. The rounds kept are those up to the lowest
    loss. Given ``path``, a training that was broken off goes on from there.
    """
    require_columns(tickets, [*REQUIRED, "Submission_Date"])
    labelled = tickets.where(F.col(LABEL).isNotNull())
    prepared = categorical_inputs(stratified_split(labelled, LABEL, key))
    numbers = [f"model_{n}" for n in LIGHT_NUMBERS]
    # Texts are needed as categories only, so their hashes are carried.
    categories = [_category(c).alias(f"category_{c}") for c in CATEGORY_COLUMNS]
    inputs = store(prepared.select(key, LABEL, "split", *categories, *numbers), "categorical-inputs")
    labels = [row[0] for row in train_part(inputs).select(LABEL).distinct().orderBy(LABEL).collect()]
    encoded = target_flags(inputs, LABEL, labels)
    for column in CATEGORY_COLUMNS:
        targets = {f"{column}_{number}": f"is_{label}" for number, label in enumerate(labels)}
        few = column in CATEGORICAL
        encoded = store(ordered_target_encode(encoded, f"category_{column}", targets, key, few), "encoded")
    names = [f"{column}_{number}" for column in CATEGORY_COLUMNS for number in range(len(labels))]
    assembler = VectorAssembler(inputCols=[*names, *numbers], outputCol="features")
    assembled = store(assembler.transform(encoded).select(key, LABEL, "split", "features"), "encoded-features")
    watched = assembled.where((F.col("split") == "train") | (F.col("split") == validation))
    settings = BoostSettings(rounds, depth, step, 1.0, 1.0, 0.0, l2, bins, seed, patience)
    # With the training part itself as ``validation`` all rows train and are watched.
    found = boost(
        watched, class_number(labels), len(labels), len(names) + len(numbers), settings, key,
        train=F.col("split") == "train", watch=F.col("split") == validation, path=path,
    )
    trees = SoftmaxTrees.of(found, labels, depth, "features", SCORES)
    scored = trees.transform(test_part(assembled))
    encodings = store(category_counts(train_part(inputs), CATEGORY_COLUMNS, labels), "encodings")
    fitted = CategoricalBoosting(encodings, PipelineModel([assembler, trees]), len(found.trees), tuple(found.losses))
    return fitted, scored.select(key, LABEL, SCORES, "prediction", "predicted_label")


def category_counts(train: DataFrame, columns: list[str], labels: list[str]) -> DataFrame:
    """Training rows per category column and category, and how many of them are of each class.

    The row without a column name counts all rows.
    """
    marked = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"category_{c}").alias("category")) for c in columns])
    everything = F.array(F.struct(F.lit("").alias("name"), F.lit("").alias("category")))
    rows = train.select(LABEL, F.explode(F.concat(marked, everything)).alias("c"))
    of_class = [F.sum((F.col(LABEL) == label).cast("double")).alias(f"n{i}") for i, label in enumerate(labels)]
    return rows.groupBy("c.name", "c.category").agg(F.count(F.lit(1)).cast("double").alias("n"), *of_class)


def _category(column: str) -> Column:
    return F.md5(F.coalesce(F.col(f"model_{column}"), F.lit("")))


def encode_with(inputs: DataFrame, encodings: DataFrame, classes: int, smoothing: float = 1.0) -> DataFrame:
    """Encode the category columns of new tickets by the stored counts; an unseen category gets the overall share."""
    counts = [f"n{i}" for i in range(classes)]
    overall = encodings.where("name = ''").select("n", *counts).first()
    for column in CATEGORY_COLUMNS:
        seen = encodings.where(F.col("name") == column).select(
            F.col("category").alias("__category"), F.struct("n", *counts).alias("__seen")
        )
        joined = inputs.join(seen, _category(column) == F.col("__category"), "left")
        total = F.coalesce(F.col("__seen.n"), F.lit(0.0)) + smoothing
        encoded = {
            f"{column}_{i}": (F.coalesce(F.col(f"__seen.{n}"), F.lit(0.0)) + smoothing * overall[n] / overall["n"]) / total
            for i, n in enumerate(counts)
        }
        inputs = joined.withColumns(encoded).drop("__category", "__seen")
    return inputs


def confidences(scored: DataFrame, labels: list[str], keep: list[str]) -> DataFrame:
    """One row per ticket and class: its label and the confidence in percent, to two digits."""
    exploded = scored.select(*keep, F.posexplode_outer(SCORES).alias("class_number", "share"))
    names = F.array(*[F.lit(x) for x in labels])
    return exploded.select(
        *keep,
        F.coalesce(F.get(names, F.col("class_number")), F.col("class_number").cast("string")).alias("label"),
        half_even(F.col("share") * 100, 2).alias("confidence"),
    )
