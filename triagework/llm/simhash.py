"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``distance`` bits apart have a variant in common that lies within half the distance of both.
Every distinct fingerprint emits all variants within that radius and meets the others on equal variants. Written out
that is 2,081 variants of 64 bits for a distance of 4, so the shuffle goes by a variant's leading bits: a fingerprint
travels once to each block of variants that its ball reaches (56 for 10 bits), and the task that holds a block makes the
variants in it, halving blocks that would not fit its memory.

Fingerprints that share a variant are all within ``distance`` of each other, so a chain through the smallest of them
loses no link; every emitted pair is verified by its bit distance. Copies share a fingerprint and are compared once.

Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows share a component. A component's
id is its smallest one, null if all are null. No rows give no rows; other columns are not read.
"""

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.llm.common import (
    connected_components,
    drop_scratch,
    forest,
    in_chunks,
    lowered,
    read_table,
    releasing,
    scratch,
)

SHINGLE_WORDS = 4
DISTANCE = 4
BITS = 64
#: Fingerprints aimed at per block, least leading bits, and variants a task makes at once.
BLOCK_ROWS = 1 << 18
LEAST_PREFIX = 10
VARIANTS_AT_ONCE = 1 << 21
NO_ID = (1 << 63) - 1


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words of the lowered text, joined by spaces."""
    found = lowered(text).split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends, at = [], -1
    for word in found:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; no hashes give 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(
    docs: DataFrame, words: int = SHINGLE_WORDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id``, ``text_hash`` and the signed 64-bit ``fingerprint`` of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in in_chunks(batches, 0):
            found = np.array([fingerprint(shingle_hashes(t, words)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array(found)], ["id", "text_hash", "fingerprint"])

    text = F.col(text_column).cast("string")
    chosen = docs.select(text.alias("text"), F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("h"))
    return chosen.mapInArrow(releasing(run), "id long, text_hash long, fingerprint long")


def flips(bits: int, most: int) -> list[int]:
    """Masks of ``bits`` bits with at most ``most`` of them set."""
    return [sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)]


def prefix_bits(rows: int, radius: int, least: int = LEAST_PREFIX, block_rows: int = BLOCK_ROWS) -> int:
    """Fewest leading bits with which an average block holds at most ``block_rows`` fingerprints."""
    return next((b for b in range(least, 40) if rows * len(flips(b, radius)) <= block_rows << b), 40)


def shared_variants(prints: np.ndarray, left: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of fingerprints that share a variant, in pairs with the first of the variant.

    ``left`` tells how many of the lower ``bits`` bits of each may still be flipped. Blocks with too many variants are
    halved by their next bit.
    """
    tails = [np.array(flips(bits, r), np.uint64) for r in range(int(left.max(initial=0)) + 1)]
    if bits and len(prints) > 1 and sum(len(tails[r]) * int((left == r).sum()) for r in range(len(tails))) > VARIANTS_AT_ONCE:
        bit = (prints >> np.uint64(bits - 1)) & np.uint64(1)
        for value in (0, 1):
            rest = left - (bit != value)
            here = np.flatnonzero(rest >= 0)
            for a, b in shared_variants(prints[here], rest[here], bits - 1):
                yield here[a], here[b]
        return
    if len(prints) < 2:
        return
    low = np.uint64((1 << bits) - 1)
    variants, owners = [], []
    for r, masks in enumerate(tails):
        own = np.flatnonzero(left == r)
        variants.append(((prints[own] & low)[:, None] ^ masks).ravel())
        owners.append(np.repeat(own, len(masks)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    in_order = np.sort(variant)
    met = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if not len(met):
        return
    place = np.minimum(np.searchsorted(met, variant), len(met) - 1)
    hit = met[place] == variant
    place, owner = place[hit], owner[hit]
    order = np.lexsort((owner, place))
    place, owner = place[order], owner[order]
    first = np.searchsorted(place, place)  # the first fingerprint that has the variant
    other = owner != owner[first]
    pairs = np.unique(np.stack([owner[first][other], owner[other]]), axis=1)
    yield pairs[0], pairs[1]


def near_links(distinct: DataFrame, distance: int = DISTANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links ``(a, b)`` between the fingerprints of a stored table of distinct ``fingerprint``.

    They join exactly the fingerprints that chains of at most ``distance`` differing bits join. Blocks with many times
    the rows aimed at, as when a large part of the rows are near copies of one text, are cut by further bits first.
    """
    if distance % 2:
        raise ValueError("the distance must be even")
    radius = distance // 2
    bits = prefix_bits(distinct.count(), radius, block_rows=block_rows)
    more = 8
    masks = lambda n, most: F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(m.bit_count()).alias("n")) for m in flips(n, most)])
    reach = distinct.withColumn("m", F.explode(masks(bits, radius))).select(
        "fingerprint",
        F.shiftrightunsigned("fingerprint", BITS - bits).bitwiseXOR(F.col("m.mask")).alias("block"),
        (F.lit(radius) - F.col("m.n")).alias("left"),
    )
    full = reach.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * block_rows).select("block")
    next_bits = F.shiftrightunsigned("fingerprint", BITS - bits - more).bitwiseAND(F.lit((1 << more) - 1))
    cut = (
        reach.join(full.withColumn("full", F.lit(True)), "block", "left")
        .withColumn("m", F.explode(F.when(F.col("full"), masks(more, radius)).otherwise(masks(0, 0))))
        .where("m.n <= left")
        .select(
            "block",
            F.when(F.col("full"), next_bits.bitwiseXOR(F.col("m.mask"))).otherwise(F.lit(-1)).cast("int").alias("part"),
            "fingerprint",
            (F.col("left") - F.col("m.n")).cast("int").alias("left"),
        )
    )

    def meet(table: pa.Table) -> pa.Table:
        ids, left = table["fingerprint"].to_numpy(), table["left"].to_numpy().astype(np.int8)
        prints = ids.view(np.uint64)
        rest = BITS - bits - (more if table["part"][0].as_py() >= 0 else 0)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in shared_variants(prints, left, rest):
            close = np.bitwise_count(prints[a] ^ prints[b]) <= distance
            found.append(forest(ids[a[close]], ids[b[close]]))
            if sum(len(x) for x, _ in found) > 4 * len(ids):
                found = [forest(*map(np.concatenate, zip(*found, strict=True)))]
        a, b = forest(*map(np.concatenate, zip(*found, strict=True))) if found else (ids[:0], ids[:0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cut.groupBy("block", "part").applyInArrow(meet, "a long, b long").distinct()


def components(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct ``fingerprint``, the ``root`` fingerprint of its component, and the component's smallest id.

    ``prints`` is a stored table.
    """
    distinct = scratch(prints.groupBy("fingerprint").agg(F.min("id").alias("own_id")), "prints")
    found = connected_components(near_links(distinct.select("fingerprint"), distance))
    linked = distinct.join(found, F.col("fingerprint") == F.col("node")).select("component", "own_id")
    named = linked.groupBy("component").agg(F.min("own_id").alias("component_id"))
    reached = found.join(named, "component").select("node", "component", "component_id")
    return distinct.join(reached, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint",
        F.coalesce("component", "fingerprint").alias("root"),
        F.when(F.col("component").isNull(), F.col("own_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    distance: int = DISTANCE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row of ``docs``: id, ``fingerprint`` as 16 hex digits, and ``component_id``."""
    prints = scratch(fingerprints(docs, words, id_column, text_column), "simhash")
    named = scratch(components(prints, distance), "components")
    return prints.join(named, "fingerprint").select(
        F.col("id").alias(id_column),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    distance: int = DISTANCE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` with one row per component, the one with the smallest id (null last), all columns as they were."""
    prints = scratch(fingerprints(docs, words, id_column, text_column), "simhash")
    named = scratch(components(prints, distance), "components")
    kept = (
        prints.join(named, "fingerprint")
        .where(F.col("id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("id").alias("id"), F.min("text_hash").alias("h"))
        .select(F.coalesce("id", F.lit(NO_ID)).alias("k_id"), F.col("h").alias("k_h"))
    )
    inner = docs.select(
        *[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)],
        F.coalesce(docs[f"`{id_column}`"].cast("long"), F.lit(NO_ID)).alias("k_id"),
        F.xxhash64(docs[f"`{text_column}`"].cast("string")).alias("k_h"),
    )
    one = inner.join(kept, ["k_id", "k_h"], "left_semi").dropDuplicates(["k_id", "k_h"])
    return one.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
