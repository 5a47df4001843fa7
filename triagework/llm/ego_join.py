"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1, so a cosine of at least ``cosine`` is a distance of at most epsilon. Equal vectors are
joined once. The principal directions of all vectors are found from their summed outer products; each vector falls into
a grid cell of width epsilon on the leading ones, and vectors are sorted by label and cells and cut into blocks of
consecutive rows. Blocks whose boxes on the leading directions are further apart than epsilon share no link. The others
meet on the cells of the first direction, and a task joins their sequences: it halves the intervals, skips halves that
are too far apart, and compares what is left in double precision.

Only sums per vector and a spanning forest of the links leave a task, so a group of near copies costs no pairs outside.

Vectors that are null, zero or hold null or non-finite components, or whose label is null, link with nothing. Vectors of
different lengths are not compared. Repeated rows are vectors of their own. No rows give no rows; other columns are not
read.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.llm.common import connected_components, forest, read_table, scratch

COSINE = 0.98
#: Leading directions, rows per block, and rows per side compared at once.
DIRECTIONS = 8
BLOCK_ROWS = 1_024
LEAF_ROWS = 128


def unit_vectors(vectors: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """``vec_id``, ``label`` and the vector scaled to length 1 as bytes of doubles; null if it links with nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            labels = batch.column(1).is_valid().to_pylist()
            for labelled, values in zip(labels, batch.column(2), strict=True):
                unit = None
                if labelled and values.is_valid and len(values) and not values.values.null_count:
                    x = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(top) and top > 0:
                        x = x / top
                        unit = (x / np.sqrt(x @ x) + 0.0).tobytes()
                out.append(unit)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["vec_id", "label", "unit"])

    kinds = [vectors.schema[c].dataType.simpleString() for c in (id_column, "label")]
    return vectors.select(id_column, "label", "embedding").mapInArrow(
        run, f"vec_id {kinds[0]}, label {kinds[1]}, unit binary"
    )


def principal_directions(distinct: DataFrame, directions: int = DIRECTIONS) -> dict[int, np.ndarray]:
    """Per vector length, the leading directions of all vectors; one matrix per length reaches the driver."""

    def outer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            by_length: dict[int, list[bytes]] = {}
            for unit in batch.column(0).to_pylist():
                by_length.setdefault(len(unit) // 8, []).append(unit)
            for n, units in by_length.items():
                x = np.frombuffer(b"".join(units)).reshape(-1, n)
                x = np.hstack([x, np.ones((len(x), 1))])
                sums[n] = sums.get(n, 0) + x.T @ x
        for n, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "sums"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p) for p in parts["sums"].to_pylist())
        return pa.table({"n": parts["n"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    tasks = 4 * distinct.sparkSession.sparkContext.defaultParallelism
    counted = distinct.select("unit").coalesce(tasks).mapInArrow(outer, "n long, sums binary")
    found = {}
    for n, sums in counted.groupBy("n").applyInArrow(add, "n long, sums binary").collect():
        total = np.frombuffer(bytes(sums)).reshape(n + 1, n + 1)
        mean = total[n, :n] / total[n, n]
        _, axes = np.linalg.eigh(total[:n, :n] / total[n, n] - np.outer(mean, mean))
        found[n] = np.ascontiguousarray(axes[:, ::-1][:, :directions])
    return found


def in_grid_order(distinct: DataFrame, axes: dict[int, np.ndarray], epsilon: float, block_rows: int) -> DataFrame:
    """Stored blocks of consecutive vectors in grid order: label, length, box, and the vectors with ids and counts."""
    most = max((a.shape[1] for a in axes.values()), default=0)

    def locate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for unit in batch.column(1).to_pylist():
                x = np.frombuffer(unit)
                cells.append(np.floor(x @ axes[len(x)] / epsilon).astype(np.int32).tolist())
            sizes = pa.array([len(u) // 8 for u in batch.column(1).to_pylist()], pa.int32())
            columns = [*batch.columns, sizes, pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "length", "cells"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, held = TaskContext.get().partitionId() << 32, 0, []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            units = np.frombuffer(b"".join(r[1] for r in rows)).reshape(len(rows), -1)
            place = units @ axes[units.shape[1]]
            columns = [
                pa.array([base + number], pa.int64()),
                pa.array([rows[0][0]], label_kind),
                pa.array([units.shape[1]], pa.int32()),
                pa.array([place.min(axis=0).tolist()], pa.list_(pa.float64())),
                pa.array([place.max(axis=0).tolist()], pa.list_(pa.float64())),
                pa.array([np.array([r[2] for r in rows], np.int64).tobytes()], pa.binary()),
                pa.array([np.array([r[3] for r in rows], np.int64).tobytes()], pa.binary()),
                pa.array([units.tobytes()], pa.binary()),
            ]
            number += 1
            return pa.RecordBatch.from_arrays(columns, ["block", "label", "length", "low", "high", "nodes", "counts", "units"])

        label_kind = pa.null()
        for batch in batches:
            label_kind = batch.schema.field(0).type
            for row in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if held and (len(held) == block_rows or held[0][0] != row[0] or len(held[0][1]) != len(row[1])):
                    yield block(held)
                    held = []
                held.append(row)
        if held:
            yield block(held)

    kind = distinct.schema["label"].dataType.simpleString()
    located = distinct.select("label", "unit", "node", "n").mapInArrow(
        locate, f"label {kind}, unit binary, node long, n long, length int, cells array<int>"
    )
    order = ["label", "length", *[F.get("cells", F.lit(i)) for i in range(most)], "node"]
    return scratch(
        located.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            cut,
            f"block long, label {kind}, length int, low array<double>, high array<double>, nodes binary, counts binary, "
            "units binary",
        ),
        "blocks",
    )


def close_blocks(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs ``(a, b)`` of blocks of a label, ``a <= b``, whose boxes are at most epsilon apart."""
    reach = epsilon * (1 + 1e-9) + 1e-12
    boxes = blocks.select("block", "label", "length", "low", "high")
    cell = lambda c: F.floor(F.get(c, F.lit(0)) / F.lit(reach))
    left = boxes.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
    right = boxes.withColumn("cell", F.explode(F.sequence(cell("low") - 1, cell("high") + 1))).select(
        *[F.col(c).alias(f"r_{c}") for c in ("block", "label", "length", "low", "high", "cell")]
    )
    gaps = F.zip_with(
        F.zip_with("low", "r_high", lambda a, b: a - b),
        F.zip_with("r_low", "high", lambda a, b: a - b),
        lambda a, b: F.greatest(a, b, F.lit(0.0)),
    )
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    same = (
        (F.col("label") == F.col("r_label"))
        & (F.col("length") == F.col("r_length"))
        & (F.col("cell") == F.col("r_cell"))
        & (F.col("block") <= F.col("r_block"))
    )
    return (
        left.join(right, same)
        .where(apart <= F.lit(reach * reach))
        .select(F.col("block").alias("a"), F.col("r_block").alias("b"))
        .distinct()
    )


class Sequences:
    """Join of two sequences of unit vectors in grid order, or of one with itself."""

    def __init__(self, a: np.ndarray, b: np.ndarray, axes: np.ndarray, cosine: float, same: bool) -> None:
        self.a, self.b, self.cosine, self.same = a, b, cosine, same
        self.pa, self.pb = a @ axes, b @ axes
        self.limit = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from self._join(0, len(self.a), 0, len(self.b))

    def _join(self, a0: int, a1: int, b0: int, b1: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if a0 == a1 or b0 == b1 or (self.same and b1 <= a0):
            return
        p, q = self.pa[a0:a1], self.pb[b0:b1]
        gap = np.maximum(0, np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)))
        if gap @ gap > self.limit:
            return
        if max(a1 - a0, b1 - b0) <= LEAF_ROWS:
            i, j = np.nonzero(self.a[a0:a1] @ self.b[b0:b1].T >= self.cosine)
            i, j = i + a0, j + b0
            if self.same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            return
        am, bm = (a0 + a1 + 1) // 2, (b0 + b1 + 1) // 2
        for s, t in ((a0, am), (am, a1)) if a1 - a0 > LEAF_ROWS else ((a0, a1),):
            for u, v in ((b0, bm), (bm, b1)) if b1 - b0 > LEAF_ROWS else ((b0, b1),):
                yield from self._join(s, t, u, v)


def linked(blocks: DataFrame, pairs: DataFrame, axes: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """``(node, links, other)``: links to add to a node, or a link of the forest (``other`` is not null)."""
    data = ("nodes", "counts", "units")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                a, b, length, *parts = (c[at].as_py() for c in batch.columns)
                ids_a, n_a, ids_b, n_b = (np.frombuffer(parts[i], np.int64) for i in (0, 1, 3, 4))
                units_a, units_b = (np.frombuffer(parts[i]).reshape(-1, length) for i in (2, 5))
                more_a, more_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
                tree = (ids_a[:0], ids_a[:0])
                for i, j in Sequences(units_a, units_b, axes[length], cosine, a == b).links():
                    np.add.at(more_a, i, n_b[j])
                    np.add.at(more_b, j, n_a[i])
                    tree = forest(np.concatenate([tree[0], ids_a[i]]), np.concatenate([tree[1], ids_b[j]]))
                node = np.concatenate([ids_a[more_a > 0], ids_b[more_b > 0], tree[0]])
                links = np.concatenate([more_a[more_a > 0], more_b[more_b > 0], np.zeros(len(tree[0]), np.int64)])
                other = pa.concat_arrays([pa.nulls(len(node) - len(tree[1]), pa.int64()), pa.array(tree[1], pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links), other], ["node", "links", "other"])

    side = lambda name: blocks.select(F.col("block").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in data])
    lengths = blocks.select(F.col("block").alias("a"), "length")
    whole = pairs.join(lengths.join(side("a"), "a"), "a").join(side("b"), "b")
    return whole.select("a", "b", "length", *[f"{s}_{c}" for s in "ab" for c in data]).mapInArrow(
        meet, "node long, links long, other long"
    )


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    directions: int = DIRECTIONS,
    block_rows: int = BLOCK_ROWS,
    id_column: str = "vec_id",
) -> DataFrame:
    """Per row of ``vectors`` (id, label, embedding): id, ``n_links``, ``component_id``, ``kept``."""
    epsilon = float(np.sqrt(2 - 2 * cosine))
    rows = scratch(
        unit_vectors(vectors, id_column)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("h1", F.when(F.col("unit").isNotNull(), F.xxhash64("unit")))
        .withColumn("h2", F.xxhash64(F.lit(7), "unit")),
        "units",
    )
    distinct = scratch(
        rows.where("unit is not null")
        .groupBy("label", "unit")
        .agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("own_id"))
        .withColumn("h1", F.xxhash64("unit"))
        .withColumn("h2", F.xxhash64(F.lit(7), "unit")),
        "vectors",
    )
    axes = principal_directions(distinct, directions)
    blocks = in_grid_order(distinct, axes, epsilon, block_rows)
    found = scratch(linked(blocks, close_blocks(blocks, epsilon), axes, cosine), "links")
    sums = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    tree = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    member = connected_components(tree).select(F.col("node").alias("c_node"), "component")
    placed = (
        distinct.drop("unit")
        .join(sums.withColumnRenamed("node", "s_node"), F.col("node") == F.col("s_node"), "left")
        .join(member, F.col("node") == F.col("c_node"), "left")
        .withColumn("component", F.coalesce("component", "node"))
        .select("label", "h1", "h2", "n", F.coalesce("links", F.lit(0)).alias("links"), "component", "own_id")
    )
    placed = scratch(placed, "placed")
    named = placed.groupBy("component").agg(F.min("own_id").alias("component_id"))
    whole = placed.join(named, "component").select(
        F.col("label").alias("p_label"),
        F.col("h1").alias("p_h1"),
        F.col("h2").alias("p_h2"),
        (F.col("links") + F.col("n") - 1).alias("n_links"),
        "component_id",
    )
    same = (
        (F.col("label") == F.col("p_label"))
        & (F.col("h1") == F.col("p_h1"))
        & (F.col("h2") == F.col("p_h2"))
    )
    out = rows.join(whole, same, "left")
    component = F.when(F.col("p_h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("long")
    return out.select(
        F.col("vec_id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
    ).withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))


def op3_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))



OP3_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
n as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as norm from v where list_dot_product(e, e) > 0),
links as (
  select a.vec_id as a, b.vec_id as b
  from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach as (
  select a, b from links
  union
  select r.a, l.b from reach r join links l on r.b = l.a),
counts as (select a, count(*) as n_links from links group by a),
named as (select a, min(b) as first from reach group by a)
select vec_id, coalesce(n_links, 0) as n_links, least(vec_id, coalesce(first, vec_id)) as component_id,
  vec_id = least(vec_id, coalesce(first, vec_id)) as kept
from embeddings left join counts on counts.a = vec_id left join named on named.a = vec_id
"""
