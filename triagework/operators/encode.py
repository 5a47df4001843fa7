"""Label codes, one-hot positions, scaling and target encoding."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagework.session import broadcast_if_small, settle

FOLDS = 5
HOT_SHARE = 1000


def label_mapping(train: DataFrame, label: str = "Priority_Level") -> DataFrame:
    """The labels that occur, numbered from 0 in alphabetical order."""
    labels = train.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    return labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("code"))


def mapping_from_dict(spark: SparkSession, layout: dict) -> DataFrame:
    """Mapping table of a label dictionary: ``{label: code}``, or the same under ``label_to_number``, or
    ``{code: label}`` under ``number_to_label``.
    """
    if "number_to_label" in layout:
        pairs = [(label, int(code)) for code, label in layout["number_to_label"].items()]
    else:
        pairs = [(label, int(code)) for label, code in layout.get("label_to_number", layout).items()]
    return spark.createDataFrame(pairs, "label string, code int")


def encode_labels(df: DataFrame, mapping: DataFrame, label: str = "Priority_Level", name: str = "label_code"):
    """Add the code of each row's label, null for a label not in ``mapping``."""
    codes = broadcast_if_small(mapping.select(F.col("label").alias(label), F.col("code").alias(name)))
    return df.join(codes, label, "left")


def decode_labels(df: DataFrame, mapping: DataFrame, code: str = "label_code", name: str = "label") -> DataFrame:
    """Add the label of each row's code; a code without label becomes its own text."""
    labels = broadcast_if_small(mapping.select(F.col("code").alias(code), F.col("label").alias("__label")))
    joined = df.join(labels, code, "left")
    return joined.withColumn(name, F.coalesce("__label", F.col(code).cast("string"))).drop("__label")


def population_deviations(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Population standard deviation per column; 1 where a column does not vary, so scaling leaves it as is."""
    row = train.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    return {c: row[c] or 1.0 for c in columns}


def scale_by_deviation(df: DataFrame, deviations: dict[str, float]) -> DataFrame:
    """Divide by the deviation without centring."""
    return df.withColumns({f"{c}_scaled": F.col(c) / F.lit(d) for c, d in deviations.items()})


def target_encode(
    df: DataFrame,
    column: str,
    targets: dict[str, str],
    key: str,
    few_values: bool,
    smoothing: float = 1.0,
    folds: int = FOLDS,
    source: DataFrame | None = None,
) -> DataFrame:
    """Replace a category by the smoothed mean of 0/1 targets, seen on other training rows.

    ``df`` has a ``split`` column. A test row sees all training rows of its category; a training row sees those of the
    other folds only, so it never sees its own target. An unseen category gets the overall mean. ``targets`` maps
    result columns to 0/1 target columns.

    The statistics come from ``source``, by default ``df`` itself; pass it when ``df`` already carries other encodings.

    With ``few_values`` the statistics are joined whole, by broadcast when their measured size allows. Otherwise the
    hot categories, at most ``HOT_SHARE`` of them, are broadcast and only the rows of the others are shuffled.
    """
    hashes = {
        "__fold": fold_of(key, folds),
        "__category": F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))),
    }
    hashed = df.withColumns(hashes)
    train = (df if source is None else source).where(F.col("split") == "train").withColumns(hashes)
    sums = [F.sum(F.col(t).cast("double")).alias(t) for t in targets.values()]
    overall = train.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    measures = ["n", *targets.values()]
    statistics = (
        train.groupBy("__category", "__fold")
        .agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)
        .groupBy("__category")
        .agg(
            F.struct(
                *[F.sum(m).alias(m) for m in measures], F.collect_list(F.struct("__fold", *measures)).alias("folds")
            ).alias("__seen")
        )
    )
    if few_values:
        joined = hashed.join(broadcast_if_small(settle(statistics)), "__category", "left")
    else:
        joined = _join_with_hot_keys(hashed, statistics, key, overall["n"])

    own_fold = F.get(F.filter("__seen.folds", lambda x: x["__fold"] == F.col("__fold")), F.lit(0))

    def seen(measure: str):
        own = F.when(F.col("split") == "train", own_fold[measure])
        return F.coalesce(F.col("__seen")[measure] - F.coalesce(own, F.lit(0.0)), F.lit(0.0))

    encoded = {}
    for name, target in targets.items():
        prior = (overall[target] or 0.0) / overall["n"] if overall["n"] else 0.0
        encoded[name] = (seen(target) + F.lit(smoothing * prior)) / (seen("n") + F.lit(smoothing))
    return joined.withColumns(encoded).drop("__fold", "__category", "__seen")


def ordered_target_encode(
    df: DataFrame,
    column: str,
    targets: dict[str, str],
    key: str,
    few_values: bool,
    smoothing: float = 1.0,
    piece_rows: int = 200_000,
) -> DataFrame:
    """Replace a category by the smoothed mean of 0/1 targets over the training rows that come before in a random order.

    The order is that of the key's hash, then of the key and the targets. A training row sees the rows of its category
    before it, so never its own target; a test row sees all training rows of its category. The first row of a category,
    and an unseen one, get the overall mean. ``targets`` maps result columns to 0/1 target columns.

    The order is cut into pieces of about ``piece_rows`` rows. Sums per (category, piece) give each piece its start, and
    windows run inside pieces, so no task holds a hot category; a category has at most one sum per piece.
    """
    measures = ["__one", *targets.values()]
    train = df.where(F.col("split") == "train").withColumn("__one", F.lit(1.0))
    overall = train.agg(*[F.sum(F.col(m).cast("double")).alias(m) for m in measures]).first()
    rows = overall["__one"] or 0.0
    priors = {t: (overall[t] or 0.0) / rows if rows else 0.0 for t in targets.values()}
    pieces = max(1, -(-int(rows) // piece_rows))
    order = F.md5(F.col(key).cast("string"))
    piece = F.floor(F.conv(F.substring("__order", 1, 6), 16, 10).cast("long") * pieces / F.lit(1 << 24))
    ordered = train.withColumns(
        {"__order": F.coalesce(order, F.lit("")), "__category": F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")))}
    ).withColumn("__piece", piece)
    sums = settle(
        ordered.groupBy("__category", "__piece").agg(*[F.sum(F.col(m).cast("double")).alias(m) for m in measures])
    )
    earlier = Window.partitionBy("__category").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("__category").alias("__c"), F.col("__piece").alias("__p"),
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0.0)).alias(f"__start_{i}") for i, m in enumerate(measures)],
    )
    within = Window.partitionBy("__category", "__piece").orderBy("__order", key, *targets.values())
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumns(
        {f"__seen_{i}": F.coalesce(F.sum(F.col(m).cast("double")).over(within), F.lit(0.0)) for i, m in enumerate(measures)}
    ).join(starts, (F.col("__category") == F.col("__c")) & (F.col("__piece") == F.col("__p")))
    seen = {m: F.col(f"__seen_{i}") + F.col(f"__start_{i}") for i, m in enumerate(measures)}
    encoded = {
        name: (seen[target] + F.lit(smoothing * priors[target])) / (seen["__one"] + F.lit(smoothing))
        for name, target in targets.items()
    }
    others = target_encode(df.where(F.col("split") != "train"), column, targets, key, few_values, smoothing, source=df)
    return placed.select(*df.columns, *[c.alias(n) for n, c in encoded.items()]).unionByName(
        others.select(*df.columns, *encoded)
    )


def fold_of(key: str, folds: int) -> Column:
    """Fold of a row, from the first hex digits of its key's hash."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("int"), F.lit(folds))


def _join_with_hot_keys(rows: DataFrame, statistics: DataFrame, key: str, total: int) -> DataFrame:
    """Left join by ``__category``: hot categories by broadcast, their rows then match nothing in the shuffle join.

    At most ``HOT_SHARE`` categories can hold one in ``HOT_SHARE`` rows, which bounds the broadcast table.
    """
    hot = F.broadcast(settle(statistics.where(F.col("__seen.n") * HOT_SHARE >= total)))
    by_hot = rows.join(hot.select("__category", F.col("__seen").alias("__hot")), "__category", "left")
    spread = F.concat(F.lit("#"), F.md5(F.col(key).cast("string")))
    keyed = by_hot.withColumn("__key", F.when(F.col("__hot").isNull(), F.col("__category")).otherwise(spread))
    others = statistics.select(F.col("__category").alias("__key"), "__seen")
    joined = keyed.join(others, "__key", "left")
    return joined.withColumn("__seen", F.coalesce("__hot", "__seen")).drop("__hot", "__key")


def target_flags(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """One 0/1 column ``is_<label>`` per label."""
    return df.withColumns({f"is_{x}": F.coalesce((F.col(label) == x).cast("int"), F.lit(0)) for x in labels})


def settled_mapping(train: DataFrame, label: str = "Priority_Level") -> DataFrame:
    return settle(label_mapping(train, label))
