"""Hard-negative mining over an inverted multi-index.

Every vector is cut into halves and each half goes to the nearest of a codebook's centres; the two centres name a cell.
A half's product with a query's half is at most the product with the centre plus the query's length times the radius of
the centre's members, so the sum of two such bounds is no less than any score in the cell. A multi-sequence heap visits
a query's cells by falling sum, first until ``first_rows`` vectors were met, then on from there until the next sum lies
below the k-th score of every window (or the window's lower end): then no cell that is left can change the answer.
Cells whose scores all lie above a window are passed over.

Two such searches run one after the other: the first ``positives`` rows of the anchor's label, and for each of those the
first ``negatives`` rows of other labels whose score lies in ``low`` to ``high`` percent of the positive's.

Codebooks are fitted on at most ``SAMPLE_BYTES`` of vectors, those whose ids have the smallest hashes; every vector is in
the index and results are exact whatever the codebooks are. Cells are laid side by side in buckets of bounded size, larger
cells over several buckets. A query is sent once to every bucket that holds cells it visits; where very many queries visit
one bucket, copies of the bucket share them. A task holds one bucket and a few queries at a time, and gives back the best
rows per window only. Codebooks and the counts of cells (``MAX_CODES`` squared at most) are all that reaches the driver.

Scores are exact integers as long as they fit a long. Vectors are integers; components that a shorter vector lacks
count as 0. Rows with a null id, label or vector, or a null component, take no part. Rows of the anchor's own id are not
its positives; otherwise repeated rows are rows of their own, and ties go by the smaller id. An anchor or positive
without negatives gives no rows; fewer than asked for are all returned. No rows give no rows. Other columns are not read.
"""

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagework.llm.common import read_table, scratch

SAMPLE_BYTES = 16 << 20
MAX_CODES = 256
ROWS_PER_CELL = 256
#: Bytes of vectors in a bucket at most, and the number of buckets that small tables are dealt to.
BUCKET_BYTES = 16 << 20
BUCKETS = 32
#: Queries that share one copy of a bucket, and scores held at once.
QUERIES_PER_COPY = 8_192
SCORES_AT_ONCE = 1 << 21
FIRST_ROWS = 4_096
ROUNDS_OF_MEANS = 12

NONE = np.iinfo(np.int64).min


def fit_codes(points: np.ndarray, codes: int) -> np.ndarray:
    """Centres of ``points`` by k-means; they start from evenly spaced points in the order of their first direction."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= codes:
        return distinct
    centred = distinct - distinct.mean(axis=0)
    axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    order = np.argsort(centred @ axis, kind="stable")
    centres = distinct[order[np.linspace(0, len(order) - 1, codes).astype(np.int64)]]
    for _ in range(ROUNDS_OF_MEANS):
        own = nearest(points, centres)
        counts = np.bincount(own, minlength=codes)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def cells_by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All pairs of places by falling sum: a pair is offered once the pairs before it in its row and column were taken."""
    order_a, order_b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    if not order_a or not order_b:
        return
    a, b = first[order_a].tolist(), second[order_b].tolist()
    taken_in_row = [0] * len(a)
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, order_a[i], order_b[j]
        taken_in_row[i] = j + 1
        if i + 1 < len(a) and taken_in_row[i + 1] == j:
            heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))
        if j + 1 < len(b) and (i == 0 or taken_in_row[i - 1] > j + 1):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))


@dataclass
class Codebooks:
    """Two half-space codebooks; after the index is made, also radii, counts of cells, and where they lie."""

    halves: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] | None = None
    counts: np.ndarray | None = None
    first_bucket: np.ndarray | None = None
    buckets_of: np.ndarray | None = None

    @property
    def split(self) -> int:
        return self.halves[0].shape[1]

    def assign(self, vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per half: each vector's centre and its distance from it."""
        codes, distances = [], []
        for centres, part in zip(self.halves, (vectors[:, : self.split], vectors[:, self.split :]), strict=True):
            own = nearest(part, centres)
            codes.append(own)
            distances.append(np.sqrt(((part - centres[own]) ** 2).sum(axis=1)))
        return codes, distances

    def visits(
        self, query: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray | None, first_rows: int
    ) -> list[int]:
        """Cells a query visits: the first ones (``need`` is None), or those after them until every window is certified."""
        middles, reaches = [], []
        for centres, radii, part in zip(self.halves, self.radii, (query[: self.split], query[self.split :]), strict=True):
            length = np.sqrt(part @ part)
            middles.append(centres @ part)
            # Sums of doubles are a little off; bounds must not be.
            reaches.append(length * radii + 1e-9 * (np.abs(centres) @ np.abs(part) + length * radii) + 1e-6)
        least = low if need is None else np.maximum(low, need)
        out, met = [], 0
        for bound, i, j in cells_by_bound(middles[0] + reaches[0], middles[1] + reaches[1]):
            if need is not None and bound < least.min():
                break
            count = int(self.counts[i, j])
            if not count:
                continue
            early = met < first_rows
            met += count
            if early != (need is None):
                if need is None:
                    break
                continue
            lowest = middles[0][i] - reaches[0][i] + middles[1][j] - reaches[1][j]
            if ((bound >= least) & (lowest <= high)).any():
                out.append(i * self.counts.shape[1] + j)
        return out


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def prepared(vectors: DataFrame, id_column: str, label_column: str, vector_column: str) -> tuple[DataFrame, int, int, int]:
    """Usable rows as ``row``, ``vec_id``, ``label``, ``vector`` of one width; their number, width and largest component."""
    chosen = vectors.select(
        F.col(id_column).alias("vec_id"),
        F.col(label_column).alias("label"),
        F.col(vector_column).cast("array<long>").alias("vector"),
    ).where("vec_id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    told = chosen.agg(
        F.count(F.lit(1)), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))
    ).first()
    rows, width, largest = int(told[0]), int(told[1] or 0), int(told[2] or 0)
    padded = F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vector")))
    whole = chosen.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", padded.alias("vector"))
    return scratch(whole, "vectors"), rows, width, largest


def build_index(rows: DataFrame, total: int, width: int) -> tuple[DataFrame, Codebooks]:
    """``rows`` with their ``cell`` and ``bucket``, and the codebooks with radii and counts."""
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(max(1, SAMPLE_BYTES // (8 * max(1, width))))
    found = sample.select("vector").toArrow()["vector"].combine_chunks()
    points = as_matrix(found, width).astype(np.float64)
    codes = int(min(MAX_CODES, max(1, round((total / ROWS_PER_CELL) ** 0.5))))
    split = width // 2
    books = Codebooks((fit_codes(points[:, :split], codes), fit_codes(points[:, split:], codes)))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, b), (r, s) = books.assign(as_matrix(batch.column(3), width).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(a * len(books.halves[1]) + b), pa.array(r), pa.array(s)],
                [*batch.schema.names, "cell", "r", "s"],
            )

    added = [T.StructField("cell", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in "rs"]]
    index = scratch(rows.mapInArrow(place, T.StructType([*rows.schema.fields, *added])), "cells")
    stats = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r"), F.max("s").alias("s")).toArrow()
    shape = len(books.halves[0]), len(books.halves[1])
    cell = stats["cell"].to_numpy()
    counts, radii = np.zeros(shape, np.int64), (np.zeros(shape[0]), np.zeros(shape[1]))
    counts.flat[cell] = stats["n"].to_numpy()
    np.maximum.at(radii[0], cell // shape[1], stats["r"].to_numpy())
    np.maximum.at(radii[1], cell % shape[1], stats["s"].to_numpy())
    # Cells lie side by side in buckets; one that is larger than a bucket has buckets of its own.
    room = max(1, min(BUCKET_BYTES // (8 * max(1, width)), -(-total // BUCKETS)))
    first, several = np.zeros(counts.size, np.int64), np.ones(counts.size, np.int64)
    at, filled = 0, 0
    for c in np.flatnonzero(counts):
        n = int(counts.flat[c])
        if filled and filled + n > room:
            at, filled = at + 1, 0
        first[c], several[c] = at, max(1, -(-n // room))
        at, filled = (at, filled + n) if n < room else (at + int(several[c]), 0)
    books = Codebooks(books.halves, radii, counts, first, several)
    where = rows.sparkSession.createDataFrame(
        [(int(c), int(first[c]), int(several[c])) for c in np.flatnonzero(counts)], "cell long, first long, several long"
    )
    # At most MAX_CODES squared rows of three numbers.
    bucket = F.col("first") + F.pmod(F.xxhash64("row"), F.col("several"))
    placed = index.drop("r", "s").join(F.broadcast(where), "cell").withColumn("bucket", bucket).drop("first", "several")
    return placed, books


def requests(queries: DataFrame, books: Codebooks, width: int, first_rows: int, later: bool) -> DataFrame:
    """One row per query and bucket with the ``cells`` it visits there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = {name: batch.column(i) for i, name in enumerate(names)}
            vectors = as_matrix(at["vector"], width).astype(np.float64)
            source, buckets, cells = [], [], []
            for i in range(batch.num_rows):
                low, high, need = (
                    np.array(at[c][i].as_py(), np.float64) if c in at else None for c in ("low", "high", "need")
                )
                by_bucket: dict[int, list[int]] = {}
                for cell in books.visits(vectors[i], low, high, need if later else None, first_rows):
                    start = int(books.first_bucket[cell])
                    for bucket in range(start, start + int(books.buckets_of[cell])):
                        by_bucket.setdefault(bucket, []).append(cell)
                source += [i] * len(by_bucket)
                buckets += by_bucket.keys()
                cells += by_bucket.values()
            rows = batch.select(["row", "vec_id", "label", "vector", "low", "high"]).take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(buckets, pa.int64()), pa.array(cells, pa.list_(pa.int64()))],
                [*rows.schema.names, "bucket", "cells"],
            )

    fields = [f for f in queries.schema.fields if f.name != "need"]
    added = [T.StructField("bucket", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType()))]
    return queries.mapInArrow(run, T.StructType([*fields, *added]))


class Bucket:
    """Vectors of one bucket, by id."""

    def __init__(self, batches: list[pa.RecordBatch], width: int, exact: type) -> None:
        whole = pa.Table.from_batches(batches)
        self.ids = whole["vec_id"].combine_chunks()
        self.labels = whole["label"].combine_chunks()
        self.cells = whole["cell"].to_numpy()
        self.vectors = as_matrix(whole["vector"].combine_chunks(), width).astype(exact)

    def best(
        self, batch: pa.RecordBatch, width: int, k: int, same_label: bool, exact: type
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Best rows per query and window: places of queries, windows, places in the bucket, scores."""
        step = max(1, SCORES_AT_ONCE // max(1, len(self.cells)))
        known = self.labels.unique()
        labels = pc.index_in(self.labels, value_set=known).to_numpy()
        at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        asked = pc.fill_null(pc.index_in(at["label"], value_set=known), -1).to_numpy()
        own = pc.fill_null(pc.index_in(at["vec_id"], value_set=self.ids), -1).to_numpy()
        first_of_id = pc.index_in(self.ids, value_set=self.ids).to_numpy()
        vectors = as_matrix(at["vector"], width).astype(exact)
        cells = [np.array(c.as_py(), np.int64) for c in at["cells"]]
        low, high = ([np.array(v.as_py(), np.int64) for v in at[c]] for c in ("low", "high"))
        for start in range(0, batch.num_rows, step):
            some = range(start, min(start + step, batch.num_rows))
            scores = (vectors[some.start : some.stop] @ self.vectors.T).astype(np.int64)
            for i in some:
                row = scores[i - start]
                usable = (labels == asked[i]) == same_label
                if same_label and own[i] >= 0:
                    usable &= first_of_id != own[i]
                usable &= np.isin(self.cells, cells[i])
                for w in range(len(low[i])):
                    inside = np.flatnonzero(usable & (row >= low[i][w]) & (row <= high[i][w]))
                    if len(inside) > k:
                        least = np.partition(row[inside], -k)[-k]
                        inside = inside[row[inside] >= least]
                    inside = inside[np.argsort(-row[inside], kind="stable")[:k]]
                    yield np.full(len(inside), i), np.full(len(inside), w), inside, row[inside]


def meet(index: DataFrame, asked: DataFrame, width: int, largest: int, k: int, same_label: bool) -> DataFrame:
    """The best ``k`` rows of each bucket for every query's window: ``row``, ``window``, ``found_id``, ``score``."""
    asked = scratch(asked, "requests")
    exact = np.float64 if width * largest**2 < 1 << 53 else np.int64
    heavy = asked.groupBy("bucket").count().select(
        "bucket", F.ceil(F.col("count") / QUERIES_PER_COPY).cast("long").alias("copies")
    )
    # Copies of a bucket beyond the first are made where more queries ask for it than one copy serves.
    both = (
        index.join(heavy, "bucket")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .select("bucket", "copy", F.lit(0).alias("kind"), "row", "vec_id", "label", "vector", "cell",
                *[F.lit(None).cast("array<long>").alias(c) for c in ("low", "high", "cells")])
        .unionByName(
            asked.join(heavy, "bucket")
            .withColumn("copy", F.pmod(F.xxhash64("row"), F.col("copies")))
            .select("bucket", "copy", F.lit(1).alias("kind"), "row", "vec_id", "label", "vector",
                    F.lit(None).cast("long").alias("cell"), "low", "high", "cells")
        )
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "window", "found_id", "score"]
        key, held, bucket = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if (now := tuple(keys[:2, a])) != key:
                    key, held, bucket = now, [], None
                if keys[2, a] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if bucket is None:
                    bucket = Bucket(held, width, exact)
                    held = held[:1]
                parts = list(bucket.best(part, width, k, same_label, exact))
                if parts:
                    query, window, place, score = (np.concatenate(c) for c in zip(*parts, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(3).take(pa.array(query)), pa.array(window, pa.int32()), bucket.ids.take(pa.array(place)),
                         pa.array(score, pa.int64())], names,
                    )

    kind = dict(index.dtypes)["vec_id"]
    together = both.repartition("bucket", "copy").sortWithinPartitions("bucket", "copy", "kind", "vec_id")
    return together.mapInArrow(run, f"row long, window int, found_id {kind}, score long")


def first_of(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of every window, with their ``rank`` from 1."""
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "found_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    index: DataFrame, books: Codebooks, queries: DataFrame, width: int, largest: int, k: int, same_label: bool,
    first_rows: int = FIRST_ROWS,
) -> DataFrame:
    """The first ``k`` rows of each query's windows (``low`` to ``high``): ``row``, ``window``, ``found_id``, ``score``, ``rank``."""
    asked = requests(queries, books, width, first_rows, False)
    early = scratch(first_of(meet(index, asked, width, largest, k, same_label), k), "early")
    # Windows that are full need nothing below their last score.
    last = early.where(F.col("rank") == k).groupBy(F.col("row").alias("of_row")).agg(
        F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("last")
    )
    need = F.transform(
        F.sequence(F.lit(0), F.size("low") - 1),
        lambda w: F.coalesce(F.col("last")[w], F.get("low", w)),
    )
    rest = queries.join(last, F.col("row") == F.col("of_row"), "left").withColumn("need", need).drop("last", "of_row")
    late = meet(index, requests(rest, books, width, first_rows, True), width, largest, k, same_label)
    return scratch(first_of(early.drop("rank").unionByName(late), k), "found")


def mine_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    first_rows: int = FIRST_ROWS,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "vector",
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor`` is a condition on ``vec_id`` and ``label``; ``low`` and ``high`` are whole percents of the positive's score.
    """
    rows, total, width, largest = prepared(vectors, id_column, label_column, vector_column)
    kind = dict(rows.dtypes)["vec_id"]
    names = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    if not total or positives < 1 or negatives < 1:
        return rows.sparkSession.createDataFrame([], names)
    index, books = build_index(rows, total, width)
    index = scratch(index, "index")
    everything = [F.array(F.lit(v).cast("long")).alias(c) for c, v in (("low", NONE), ("high", np.iinfo(np.int64).max))]
    anchors = rows.where(is_anchor)
    near = search(index, books, anchors.select("*", *everything), width, largest, positives, True, first_rows)
    # A window per positive: 100 * negative from low * positive to high * positive, in whole numbers.
    rest = F.pmod("score", F.lit(100).cast("long"))
    hundreds = F.expr("(score - pmod(score, 100L)) div 100L")
    share = lambda percent, cut: hundreds * percent + cut(rest * percent / 100).cast("long")
    edges = near.select(F.col("row").alias("of_row"), "rank", share(low, F.ceil).alias("low"), share(high, F.floor).alias("high"))
    by_anchor = edges.groupBy("of_row").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    asking = anchors.join(by_anchor, F.col("row") == F.col("of_row")).select(
        "row", "vec_id", "label", "vector", F.col("w.low").alias("low"), F.col("w.high").alias("high")
    )
    far = search(index, books, asking, width, largest, negatives, False, first_rows)
    chosen = near.select(
        F.col("row").alias("p_row"),
        (F.col("rank") - 1).alias("p_window"),
        F.col("found_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return (
        far.join(chosen, (F.col("row") == F.col("p_row")) & (F.col("window") == F.col("p_window")))
        .join(anchors.select(F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id")), F.col("row") == F.col("a_row"))
        .select(
            "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and ``vector`` of whole numbers; ids divisible by 7 take the next of ten labels."""
    odd = "exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return vectors.where(f"label is not null and embedding is not null and not {odd}").select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vector"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_negatives(quantised(read_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


OP13_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
near as (
  select a.vec_id as anchor_id, p.vec_id as positive_id, list_dot_product(a.e, p.e)::bigint as positive_score
  from v a join v p on a.label = p.label and a.vec_id <> p.vec_id
  where a.vec_id % 100 = 0
  qualify row_number() over (partition by a.vec_id order by positive_score desc, p.vec_id) <= 5),
far as (
  select a.vec_id as anchor_id, n.vec_id as negative_id, list_dot_product(a.e, n.e)::bigint as negative_score
  from v a join v n on a.label <> n.label
  where a.vec_id % 100 = 0)
select anchor_id, positive_id,
  row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id)::integer as rank,
  negative_id, positive_score, negative_score
from near join far using (anchor_id)
where 80 * positive_score <= 100 * negative_score and 100 * negative_score <= 100 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) <= 5
"""
