"""Exact ranks over skewed groups.

Quantiles, shares and row numbers need every row's place inside its group. Sorting a group in one task fails when a
group holds a third of all rows, so each function first counts rows per (group, bucket), where buckets follow the sort
order. The counts are small; they tell which bucket holds a wanted rank, or where a bucket's numbering starts, and only
rows of one bucket are ever sorted together.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagework.session import broadcast_if, broadcast_if_small, is_small, join_null_safe, settle, store

# Buckets per octave of values, as powers of two: at first, added where a bucket is too full, and at most.
BUCKET_BITS = 10
REFINE_BITS = 12
FINEST_BITS = 40
# Rows that may be sorted together.
SORTED_ROWS = 200_000
HASH_DIGITS = 4


def exact_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, float], keysets: list[list[str]], weight: str | None = None
) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` for each key set, from two scans and small shuffles.

    With ``weight`` a row stands for that many equal ones.

    Returns ``keyset`` (position in ``keysets``), the key columns (null where a key set does not use them), ``n`` (known
    values) and one column per quantile. Null values are ignored, and so are rows with a null key of the key set.

    Hit buckets with more than ``SORTED_ROWS`` rows are cut finer, in one more scan each time, until none is left.
    """
    keys = list(dict.fromkeys(k for ks in keysets for k in ks))
    group = ["keyset", *keys]
    number = F.col(value).cast("double")
    values = (
        df.select(*keys, number.alias("value"), (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("times"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumn("fine", _value_bucket(F.col("value")))
    )
    bits = BUCKET_BITS

    def bucketed(bits: int, name: str = "bucket") -> Column:
        return F.shiftright("fine", FINEST_BITS - bits).alias(name)

    counts = values.groupBy(*keys, bucketed(bits)).agg(F.sum("times").alias("n"))
    counts = _sum_per_keyset(counts, keysets, keys, ["bucket"])
    in_order = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns(
        {"upto": F.sum("n").over(in_order), "total": F.sum("n").over(Window.partitionBy(*group))}
    )
    wanted = F.array_distinct(F.array(*[r for q in quantiles.values() for r in _ranks(F.col("total"), q)]))
    before = F.col("upto") - F.col("n")
    targets = settle(
        counts.withColumn("before", before)
        .withColumn("ranks", F.filter(wanted, lambda r: (r >= F.col("before")) & (r < F.col("upto"))))
        .where(F.size("ranks") > 0)
        .select(*group, "bucket", "total", "before", "ranks", "n")
    )
    while bits < FINEST_BITS and (targets.agg(F.max("n")).first()[0] or 0) > SORTED_ROWS:
        finer, small = min(FINEST_BITS, bits + REFINE_BITS), is_small(targets)
        hit = broadcast_if(small, targets.select("bucket").distinct())
        parts = values.select("*", bucketed(bits), bucketed(finer, "part")).join(hit, "bucket", "left_semi")
        parts = parts.groupBy(*keys, "bucket", "part").agg(F.sum("times").alias("n"))
        parts = _sum_per_keyset(parts, keysets, keys, ["bucket", "part"])
        in_bucket = Window.partitionBy(*group, "bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        targets = settle(
            join_null_safe(parts, broadcast_if(small, targets.drop("n")), [*group, "bucket"])
            .withColumn("before", F.col("before") + F.sum("n").over(in_bucket) - F.col("n"))
            .withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))))
            .where(F.size("ranks") > 0)
            .select(*group, F.col("part").alias("bucket"), "total", "before", "ranks", "n")
        )
        bits = finer

    small, targets = is_small(targets), targets.drop("n")
    hit = broadcast_if(small, targets.select("bucket").distinct())
    near = values.select("*", bucketed(bits)).join(hit, "bucket", "left_semi").groupBy(*keys, "bucket", "value").agg(F.sum("times").alias("n"))
    near = _sum_per_keyset(near, keysets, keys, ["bucket", "value"])
    in_bucket = Window.partitionBy(*group, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        join_null_safe(near, broadcast_if(small, targets), [*group, "bucket"])
        .withColumn("end", F.col("before") + F.sum("n").over(in_bucket))
        .withColumn("here", F.filter("ranks", lambda r: (r >= F.col("end") - F.col("n")) & (r < F.col("end"))))
        .select(*group, "total", "value", F.explode("here").alias("rank"))
    )
    edges, result = [F.max("total").alias("n")], []
    for name, q in quantiles.items():
        low, high = _ranks(F.col("total"), q)
        edges.append(F.max(F.when(F.col("rank") == low, F.col("value"))).alias(f"__low_{name}"))
        edges.append(F.max(F.when(F.col("rank") == high, F.col("value"))).alias(f"__high_{name}"))
        place = (F.col("n") - 1) * F.lit(q)
        low, high, part = F.col(f"__low_{name}"), F.col(f"__high_{name}"), place - F.floor(place)
        result.append(F.when(part == 0, low).otherwise(low + (high - low) * part).alias(name))
    return placed.groupBy(*group).agg(*edges).select(*group, "n", *result)


def _ranks(total: Column, q: float) -> tuple[Column, Column]:
    place = (total - 1) * F.lit(q)
    return F.floor(place), F.ceil(place)


def _value_bucket(value: Column) -> Column:
    """Whole number that grows with the value: the logarithm of its distance from 0, as finely cut as it gets."""
    return F.floor(F.signum(value) * F.log2(F.abs(value) + 1) * (1 << FINEST_BITS))


def _sum_per_keyset(counts: DataFrame, keysets: list[list[str]], keys: list[str], extra: list[str]) -> DataFrame:
    """Add up ``n`` for every key set, leaving out rows whose key is null."""
    level = F.lit(None).cast("int")
    known = F.lit(False)
    for position, used in enumerate(keysets):
        mask = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in used) << len(extra)
        here = F.col("__grouping") == mask
        level = F.when(here, F.lit(position)).otherwise(level)
        known = known | (here & reduce(lambda c, k: c & F.col(k).isNotNull(), used, F.lit(True)))
    columns = [*keys, *extra]
    return (
        counts.groupingSets([[F.col(c) for c in [*used, *extra]] for used in keysets], *[F.col(c) for c in columns])
        .agg(F.grouping_id().alias("__grouping"), F.sum("n").alias("n"))
        .where(known)
        .select(level.alias("keyset"), *columns, "n")
    )


def hash_order(key: str, seed: int) -> Column:
    """Reproducible random order of rows: the hash of their key."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def exact_share_cuts(df: DataFrame, group: str, key: str, share: float, seed: int) -> DataFrame:
    """Per group, the hash ``cut`` up to which ``ceil(share * rows)`` rows lie in hash order.

    ``tied`` rows share that hash, because their keys are equal; ``take`` of them still belong to the share.
    """
    hashed = df.select(F.col(group), hash_order(key, seed).alias("hash")).withColumn(
        "bucket", F.substring("hash", 1, HASH_DIGITS)
    )
    per_group = Window.partitionBy(group)
    in_order = per_group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = (
        hashed.groupBy(group, "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"upto": F.sum("n").over(in_order), "total": F.sum("n").over(per_group)})
        .withColumn("take", F.ceil(F.col("total") * F.lit(share)))
        .where((F.col("upto") - F.col("n") < F.col("take")) & (F.col("take") <= F.col("upto")))
    )
    edge = broadcast_if_small(
        settle(counts.select(group, "bucket", (F.col("take") - F.col("upto") + F.col("n")).alias("left_to_take")))
    )
    near = join_null_safe(hashed, edge, [group, "bucket"])
    ties = near.groupBy(group, "bucket", "hash", "left_to_take").agg(F.count(F.lit(1)).alias("tied"))
    in_bucket = Window.partitionBy(group, "bucket").orderBy("hash").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("upto") - F.col("tied")
    cuts = (
        ties.withColumn("upto", F.sum("tied").over(in_bucket))
        .where((before < F.col("left_to_take")) & (F.col("left_to_take") <= F.col("upto")))
        .select(group, F.col("hash").alias("cut"), (F.col("left_to_take") - before).alias("take"), "tied")
    )
    return settle(cuts)


def global_row_number(
    df: DataFrame, keys: list[str], levels: list[str], order: list[str], name: str
) -> DataFrame:
    """Number rows 1..n per ``keys`` in ``order``.

    ``levels`` are columns, coarse to fine, that follow the order: sorting by them, then by ``order``, is sorting by
    ``order``. Nulls come first, in keys, levels and order. Each task sorts the rows of one finest level only and starts from the count of all earlier ones.
    """
    counts = store(df.groupBy(*keys, *levels).agg(F.count(F.lit(1)).alias("n")), "counts")
    starts = counts.drop("n").withColumn("__start", F.lit(0).cast("long"))
    for depth in range(len(levels)):
        outer, inner = [*keys, *levels[:depth]], [*keys, *levels[: depth + 1]]
        earlier = Window.partitionBy(*outer).orderBy(levels[depth]).rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            counts.groupBy(*inner)
            .agg(F.sum("n").alias("n"))
            .select(*inner, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__offset"))
        )
        starts = (
            join_null_safe(starts, offsets, inner)
            .withColumn("__start", F.col("__start") + F.col("__offset"))
            .drop("__offset")
        )
    within = Window.partitionBy(*keys, *levels).orderBy(*order)
    placed = df.withColumn("__place", F.row_number().over(within))
    return (
        join_null_safe(placed, starts, [*keys, *levels])
        .withColumn(name, F.col("__start") + F.col("__place"))
        .drop("__start", "__place")
    )
