"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words with smallest period q (words q apart are identical) that neither neighbour extends, of at
least ``min_exponent`` periods and ``min_length`` words. Every period q lies in one dyadic range b <= q < 2b, and a run of
that period holds an aligned block of b words together with its copy q words on. So each block of each dyadic level asks
where it occurs next in the window of 2b words behind it. The answer is the range successor of a place among the block's
part of the suffix array, given by a wavelet tree. Occurrences that overlap by half or more form arithmetic progressions;
one step passes a whole progression, so a block asks a few times only. A block's distance to the first occurrence of a
progression, and the distances of the ends of the two stretches in which the progression's difference is a period, are
the only possible periods; each is checked by extending it both ways over the ranks of the suffix array's doubling.

Texts are worked on in groups of about a million characters, whose words are numbered per text, so that nothing matches
across texts; a longer text is a group of its own. Memory goes with the longest text, in the worst case some 8 bytes a
word and level of doubling. Rows are independent: no shuffle.

Null and empty texts, and texts of white space, have no words and no runs and collapse to an empty text. Runs of equal
length are all reported. Repeated rows repeat, no rows give no rows, other columns are not read.
"""

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.llm.common import in_chunks, read_table

MIN_LENGTH = 6
MIN_EXPONENT = 4

RUNS_TYPE = "array<struct<start:long,length:long,period:long>>"


class SuffixRanks:
    """Suffix array of a sequence by doubling; every level's ranks tell equal stretches of 2^level words."""

    def __init__(self, codes: np.ndarray, longest: int) -> None:
        n = len(codes)
        sizes = np.bincount(codes)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.order = np.argsort(codes, kind="stable").astype(np.int32)
        rank = starts[codes].astype(np.int32)
        self.ranks, self.sizes = [rank], [sizes[codes].astype(np.int32)]
        slots = np.flatnonzero(self.sizes[0][self.order] > 1)
        step = 1
        while step < longest and len(slots):
            places = self.order[slots].astype(np.int64)
            behind = places + step
            second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
            keys = rank[places] * np.int64(n + 1) + second + 1
            by_key = np.argsort(keys, kind="stable")
            places, keys = places[by_key], keys[by_key]
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            group = np.diff(np.append(edges, len(keys)))
            self.order[slots] = places
            rank, size = rank.copy(), np.ones(n, np.int32)
            rank[places] = np.repeat(slots[edges], group)
            size[places] = np.repeat(group, group)
            self.ranks.append(rank)
            self.sizes.append(size)
            slots = slots[np.repeat(group, group) > 1]
            step *= 2
        self.n = n

    def equal_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` on equal those from ``j`` on (``i < j``)."""
        i, j, start = i.copy(), j.copy(), i
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            same = (j < self.n) & (rank[np.minimum(i, self.n - 1)] == rank[np.minimum(j, self.n - 1)])
            i += same << level
            j += same << level
        return i - start

    def equal_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words just before ``i`` equal those just before ``j`` (``i < j``)."""
        i, j, start = i.copy(), j.copy(), i
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, width = self.ranks[level], 1 << level
            same = (i >= width) & (rank[np.maximum(i - width, 0)] == rank[np.maximum(j - width, 0)])
            i -= same << level
            j -= same << level
        return start - i


class WaveletTree:
    """Range successors over a sequence of different numbers, level by level from the highest bit."""

    def __init__(self, values: np.ndarray, bound: int) -> None:
        self.levels = []
        for bit in range(max(1, int(bound).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~ones, out=zeros[1:])
            self.levels.append((bit, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest number of at least ``least`` among places ``low .. high - 1`` of the sequence, -1 if there is none."""
        a, b, smaller = low, high, np.zeros(len(low), np.int64)
        for bit, zeros in self.levels:
            za, zb, one = zeros[a], zeros[b], (least >> bit) & 1 == 1
            smaller += np.where(one, zb - za, 0)
            a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
        found = smaller < high - low
        a, b, skip, value = low[found], high[found], smaller[found], np.zeros(int(found.sum()), np.int64)
        for bit, zeros in self.levels:
            za, zb = zeros[a], zeros[b]
            one = skip >= zb - za
            skip = skip - np.where(one, zb - za, 0)
            value |= one.astype(np.int64) << bit
            a, b = np.where(one, zeros[-1] + a - za, za), np.where(one, zeros[-1] + b - zb, zb)
        out = np.full(len(low), -1, np.int64)
        out[found] = value
        return out


def block_candidates(
    suffixes: SuffixRanks, tree: WaveletTree, slot_of: np.ndarray, level: int, blocks: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places of blocks of 2^level words, and periods between that length and its double that may hold there."""
    width = 1 << level
    low = slot_of[suffixes.ranks[level][blocks]]
    high = low + suffixes.sizes[level][blocks]
    at, own = blocks, np.arange(len(blocks))
    # Difference of the block's progressions, and the ends of the stretch around the block that has it as its period.
    step = np.zeros(len(blocks), np.int64)
    left, right = np.zeros(len(blocks), np.int64), np.zeros(len(blocks), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(own):
        following = tree.successor(low[own], high[own], at + 1)
        near = (following >= 0) & (following < blocks[own] + 2 * width)
        own, at, following = own[near], at[near], following[near]
        found.append((own, following, following - at))
        # A progression is passed at once: its last place is where its stretch ends.
        gap = following - at
        close = gap <= width // 2
        ends = at[close] + gap[close] + suffixes.equal_after(at[close], following[close])
        step[own[close]] = gap[close]
        at = following
        at[close] += (ends - width - following[close]) // gap[close] * gap[close]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own, place, gap = (np.concatenate(part) for part in zip(*found, strict=True))
    some = np.flatnonzero(step)
    left[some] = blocks[some] - suffixes.equal_before(blocks[some], blocks[some] + step[some])
    right[some] = blocks[some] + step[some] + suffixes.equal_after(blocks[some], blocks[some] + step[some])
    # A stretch within the block alone ends where the block's own period breaks.
    periodic = step[own] > 0
    p, d, s = blocks[own[periodic]], step[own[periodic]], place[periodic]
    starts = s - suffixes.equal_before(s, s + d)
    ends = s + d + suffixes.equal_after(s, s + d)
    where = np.concatenate([blocks[own], p, p])
    periods = np.concatenate([place - blocks[own], starts - left[own[periodic]], ends - right[own[periodic]]])
    fit = (periods >= width) & (periods < 2 * width)
    return where[fit], periods[fit]


def runs_of(
    codes: np.ndarray, longest: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs, by start and period. Words of different texts have different codes."""
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods need not hold a block and its copy")
    none = np.zeros(0, np.int64)
    if len(codes) < min_length:
        return none, none, none
    suffixes = SuffixRanks(codes, longest)
    occurrences = 3 if min_exponent >= 4 else 2
    # A window behind a block of one word has one start; it needs no tree.
    where, periods = [np.flatnonzero(codes[1:] == codes[:-1])], []
    periods.append(np.ones(len(where[0]), np.int64))
    if len(suffixes.ranks) > 1:
        usable = suffixes.sizes[1] >= occurrences
        listed = usable[suffixes.order]
        slot_of = np.concatenate([[0], np.cumsum(listed)])
        tree = WaveletTree(suffixes.order[listed].astype(np.int64), len(codes))
        for level in range(1, len(suffixes.ranks)):
            if min_exponent << level > longest:
                break
            blocks = np.arange(0, len(codes), 1 << level)
            blocks = blocks[suffixes.sizes[level][blocks] >= occurrences]
            at, period = block_candidates(suffixes, tree, slot_of, level, blocks)
            where.append(at)
            periods.append(period)
    p, q = np.concatenate(where), np.concatenate(periods)
    keys = np.unique(p * np.int64(len(codes) + 1) + q)
    p, q = keys // (len(codes) + 1), keys % (len(codes) + 1)
    start, end = p - suffixes.equal_before(p, p + q), p + q + suffixes.equal_after(p, p + q)
    long = end - start >= np.maximum(min_length, min_exponent * q)
    start, end, q = start[long], end[long], q[long]
    # Multiples of a period hold on the same stretch; the smallest one is the run's.
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.ones(len(q), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[first], end[first], q[first]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def numbered(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of the texts, numbers that differ between words and between texts, and where each text's words begin."""
    words = [(t or b"").split() for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
    codes, base = np.zeros(int(ends[-1]), np.int64), 0
    for i, row in enumerate(words):
        number: dict[bytes, int] = defaultdict(count(base).__next__)
        codes[ends[i] : ends[i + 1]] = np.fromiter(map(number.__getitem__, row), np.int64, len(row))
        base += len(number)
    return words, codes, ends


def periodic_runs(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per text: id, ``runs`` by start and period (``start``, ``length``, ``period`` in words) and ``collapsed``.

    Words are what white space (space, tab, line feed and the three after it) parts. ``collapsed`` is the text without
    the words that some run holds after its first period, joined by single spaces.
    """

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
        for rows, texts in in_chunks(batches, 1):
            words, codes, ends = numbered(texts)
            start, end, period = runs_of(codes, int(np.diff(ends).max()), min_length, min_exponent)
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, end, -1)
            kept = np.cumsum(change[:-1]) == 0
            owner = np.searchsorted(ends, start, side="right") - 1
            collapsed = []
            for i, row in enumerate(words):
                keep = kept[ends[i] : ends[i + 1]]
                if not keep.all():
                    row = [row[k] for k in np.flatnonzero(keep)]
                collapsed.append(b" ".join(row))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])
            fields = [pa.array(v) for v in (start - ends[owner], end - start, period)]
            runs = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(item))
            )
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), runs, pa.array(collapsed, pa.binary())], ["id", "runs", "collapsed"]
            )

    kind = docs.schema[id_column].dataType.simpleString()
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").cast("binary").alias("text"))
    found = chosen.mapInArrow(find, f"id {kind}, runs {RUNS_TYPE}, collapsed binary")
    return found.select(F.col("id").alias(id_column), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, in which the crc32 of the decimal id tells whether and how words are made periodic.

    With h that crc32, g = h div 10 and n words, a text with h mod 10 = 0 repeats, from word a = g mod n on, the
    1 + (n - a) div (3 + g mod 8) words that begin there. A null id changes nothing.
    """
    words: Column = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size("words")
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    period = F.slice("words", (a + 1).cast("int"), p.cast("int"))
    periods = F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int")))
    planted = F.concat(
        F.slice("words", F.lit(1), a.cast("int")), F.slice(periods, F.lit(1), (n - a).cast("int"))
    )
    # Only texts to be changed are split here.
    chosen = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    some = chosen.withColumn("words", F.when(h % 10 == 0, words))
    return some.select("doc_id", F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(read_table(spark, sf_dir, "documents")))
    ordered = F.transform(
        "runs", lambda r: F.struct(r["length"], (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))
    )
    best = found.withColumn("best", F.array_max(ordered)).withColumn(
        "lines",
        F.array_join(
            F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"
        ),
    )
    length, period = F.col("best.length"), -F.col("best.shorter")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias(
            "runs_sha256"
        ),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
