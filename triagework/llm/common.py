"""Helpers of this subpackage: scratch tables, text bytes, salted ranks and connected components."""

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagework.session import new_output_dir, shared_dir

#: A-Z to a-z on UTF-8 bytes; all other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Characters that are worked on at once.
CHUNK_CHARS = 1 << 20


#: Bytes of a batch that Spark sends to or takes from a Python worker; the default is 10,000 rows whatever their size.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let batches of texts end at ``BATCH_BYTES``, unless the session already sets a lower limit.

    The setting stays with the session, as tables are computed after the function that made them returned.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    told = spark.conf.get(name, None)
    if told is None or not told.isdigit() or int(told) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once into a Parquet table of the shared folder; the table goes when the session's JVM ends."""
    spark = df.sparkSession
    path = new_output_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a table made by ``scratch`` that no later step reads."""
    spark = df.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(conf).delete(place, True)


def release_memory() -> None:
    """Give freed memory back to the system, so that a worker that waits for its next task holds little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


Batches = Iterable[pa.RecordBatch]


def releasing(run: Callable[[Batches], Iterator[pa.RecordBatch]]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """``run``, releasing memory when its partition is done."""

    def whole(batches: Batches) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return whole


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lowered; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(LOWER)


def crc_fold(key: str, folds: int) -> Column:
    """Fold of a row: crc32 of its key as text, modulo ``folds`` (a null key counts as empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def text_batches(batches: Iterable[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that long texts stay within a worker's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def spread_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places ``start .. start + length`` of every run, one after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    some = lengths > 0
    starts, lengths = starts[some], lengths[some]
    if total:
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        out[first] = starts
        out[first[1:]] -= starts[:-1] + lengths[:-1] - 1
        np.cumsum(out, out=out)
    return out


def in_chunks(
    batches: Iterable[pa.RecordBatch], text_at: int, chars: int = CHUNK_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Runs of rows holding about ``chars`` characters, with their texts."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // chars
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield (rows := batch.slice(a, b - a)), rows.column(text_at).to_pylist()


def salted_rank(df: DataFrame, keys: list[str], order: list[str], name: str, rows_per_task: int = 500_000) -> DataFrame:
    """Number the rows of each ``keys`` group from 0 without gaps; no task holds a whole group.

    Rows are dealt by the hash of ``order`` into as many salts as keep a salt near ``rows_per_task`` rows. Counts per
    (keys, salt) give each salt its first number; inside a salt rows go by ``order``, which should tell rows apart.
    """
    salts = max(32, -(-df.count() // rows_per_task))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order, F.lit(len(order))), F.lit(salts)))
    counts = salted.groupBy(*keys, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.col("__salt").alias("__salt_of"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
    )
    same = F.col("__salt") == F.col("__salt_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = Window.partitionBy(*keys, "__salt").orderBy(*order)
    return (
        salted.withColumn("__place", F.row_number().over(inside) - 1)
        .join(starts, same)
        .withColumn(name, F.col("__start") + F.col("__place"))
        .drop("__salt", "__salt_of", "__start", "__place", *[f"__{k}" for k in keys])
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; a component is named by its smallest node.

    Alternating star contraction: each node's larger neighbours are linked to its smallest one, then each node and its
    smaller neighbours are linked to the smallest of them, until nothing changes. Minima are combined before they are
    shuffled, joins on a node with many links are left to Spark's skew handling, and every round is checkpointed.
    """
    shared_dir(edges.sparkSession)
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, seen = _settled(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        now, after = _settled(small.select("e.u", "e.v").where("u <> v").distinct())
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _settled(links: DataFrame) -> tuple[DataFrame, tuple]:
    """Reliable checkpoint of the links, with their count and a sum of hashes that tells whether they changed."""
    kept = links.checkpoint(eager=True)
    told = kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return kept, tuple(told)


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the given ones but only lead from each node to the smallest it reaches."""
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = place[: len(left)], place[len(left) :]
    low = np.arange(len(nodes))
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, low[i], m)
        np.minimum.at(new, low[j], m)
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if np.array_equal(new, low):
            break
        low = new
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]
