"""Train/test splits that depend on each row's key only, never on partitioning."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagework.operators.ranks import exact_share_cuts, global_row_number, hash_order
from triagework.session import broadcast_if_small, join_null_safe, store

SEED = 42
TIE_PARTS = 4096
TEST_SHARE = 0.2


def hash_limit(share: float) -> str:
    """Hash below which ``share`` of all hashes lie, to 8 hex digits."""
    return f"{round(share * 16**8):08x}"


def random_split(df: DataFrame, key: str, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``split`` by a hash threshold: about ``share`` of the rows are ``test``; no shuffle."""
    in_test = F.substring(hash_order(key, seed), 1, 8) < hash_limit(share)
    return df.withColumn("split", F.when(in_test, "test").otherwise("train"))


def stratified_split(df: DataFrame, label: str, key: str, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``split`` with exactly ``ceil(share * rows)`` test rows per label (null is a label of its own).

    A limit per label decides without a shuffle. Only where the limit falls into a run of rows with equal keys are those
    rows, and no others, numbered to be dealt out.
    """
    cuts = exact_share_cuts(df, label, key, share, seed)
    joined = join_null_safe(df, broadcast_if_small(cuts), [label], "left").withColumn("__hash", hash_order(key, seed))
    in_test = F.col("__hash") <= F.col("cut")
    if cuts.where("take < tied").isEmpty():
        return joined.withColumn("split", F.when(in_test, "test").otherwise("train")).select(*df.columns, "split")
    at_cut = (F.col("__hash") == F.col("cut")) & (F.col("take") < F.col("tied"))
    part = F.pmod(F.monotonically_increasing_id(), F.lit(TIE_PARTS))
    tied = store(joined.where(at_cut).withColumn("__part", part), "tied")
    numbered = global_row_number(tied, [label], ["__part"], ["__part"], "__number")
    dealt = numbered.withColumn("split", F.when(F.col("__number") <= F.col("take"), "test").otherwise("train"))
    others = joined.where(~at_cut | F.col("cut").isNull()).withColumn(
        "split", F.when(in_test, "test").otherwise("train")
    )
    return others.select(*df.columns, "split").unionByName(dealt.select(*df.columns, "split"))


def train_part(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


def test_part(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "test")


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
