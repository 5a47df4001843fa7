"""Packing tokenised documents into few sequences by linear grouping and best fit.

Only the counts per length reach the driver, at most one number per length up to the capacity. There, large lengths are
dealt into groups of equal size and rounded up to the largest of their group, so few sizes are left. For these, one
configuration of a sequence after the other is chosen: the largest size that is left, filled up as far as the sizes left
allow, as often as they last. The real lengths then take the places of the rounded ones, and small pieces go by best fit,
largest first, into the room that is left. What comes out is a table of runs: pieces of one length, from one rank on, go
to consecutive sequences. Ranks within a length are worked out by Spark, and each piece looks up its run.

Null and empty texts have the end token only. Repeated rows are pieces of their own. No rows give no sequences. Other
columns are not read.
"""

import functools
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from triagework.llm.byte_bpe import char_of_byte
from triagework.llm.common import in_chunks, read_table, releasing, salted_rank, scratch, spread_index

CAPACITY = 4096
END_ID = 1
#: The pieces of a word tokenizers file, as written there.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-case ASCII, and ASCII white space.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9 ]+"
ASCII_SPACE = r"[\t\n\v\f\r]+"
#: Groups of large lengths, and the share of the capacity above which a length is large; the best of these is taken.
SETTINGS = ((256, 1 / 8), (256, 1 / 2), (1024, 1 / 3), (1024, 1 / 2))
#: Stands between units that are cut together; private use, so it is no letter and nothing normalises it.
MARK = "\ue000"
#: Characters that are encoded at once: the more, the fewer units are looked up again.
CHUNK_CHARS = 8 << 20
#: Pieces remembered by a worker.
REMEMBERED = 900_000


class WordTokens:
    """Ids of a tokenizers file whose pieces never span a space; each unit between spaces is encoded once per batch.

    The units of a batch are normalised and cut into pieces together, as the file says: Arrow's functions do it for ASCII,
    the library's normaliser and ``regex`` for the rest, with a mark between units. The library's model encodes pieces not
    seen before; pieces are runs of one pool, and run 0 is empty.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.normal, self.model = self.tokenizer.normalizer.normalize_str, self.tokenizer.model.tokenize
        self.cut = regex.compile(PATTERN).findall
        chars = char_of_byte()
        self.written = lambda piece: "".join([chars[b] for b in piece.encode()])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0, MARK: 0}
        self.runs = array("q", [0, 0])
        self.pool = array("I")

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of the runs of different pieces; new ones are learned, short ones remembered."""
        numbers = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        places = np.flatnonzero(numbers < 0)
        new = [pieces[i] for i in places.tolist()]
        numbers[places] = np.arange(len(self.runs) - 1, len(self.runs) - 1 + len(new))
        for number, piece in zip(numbers[places].tolist(), new, strict=True):
            text = piece if piece.isascii() and piece.isprintable() else self.written(piece)
            self.pool.extend([token.id for token in self.model(text)])
            self.runs.append(len(self.pool))
            if len(piece) < 64:
                self.known[piece] = number
        return numbers

    def _ids_of(self, pieces: pa.Array, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units laid end to end and their number per unit, given the pieces and how many belong to each unit.

        Without ``counts`` a mark ends each unit.
        """
        coded = pieces.dictionary_encode()
        numbers = self._numbers(strings(coded.dictionary))[coded.indices.to_numpy()]
        if counts is None:
            counts = np.diff(np.flatnonzero(numbers == 0), prepend=-1)
        runs = np.frombuffer(self.runs, np.int64)
        starts, lengths = runs[numbers], runs[numbers + 1] - runs[numbers]
        ids = np.frombuffer(self.pool, np.uint32)[spread_index(starts, lengths)]
        return ids, np.add.reduceat(lengths, np.cumsum(counts) - counts)

    def _plain(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lowered = pc.replace_substring_regex(pc.ascii_lower(units), ASCII_SPACE, " ")
        cut = pc.split_pattern(pc.replace_substring_regex(lowered, ASCII_PATTERN, r"\0 "), " ")
        return self._ids_of(cut.flatten(), pc.list_value_length(cut).to_numpy())

    def _others(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        joined = f" {MARK} ".join([*strings(units), ""])
        return self._ids_of(pa.array(self.cut(self.normal(joined)), pa.string()))

    def _apart(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [self.tokenizer.encode(unit, add_special_tokens=False).ids for unit in strings(units)]
        return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)

    def encode_batch(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text's followed by ``end_id``, and how many belong to each text."""
        if len(self.runs) > REMEMBERED:
            self.forget()
        split = pc.split_pattern(pc.fill_null(pa.array(texts, pa.string()), ""), " ")
        inside = np.cumsum(pc.list_value_length(split).to_numpy())
        coded = split.flatten().dictionary_encode()
        units = coded.dictionary
        # Special tokens are found before anything is normalised, and a unit may hold the mark itself.
        apart = np.zeros(len(units), bool)
        for text in (*self.special, MARK):
            apart |= pc.match_substring(units, text).to_numpy(zero_copy_only=False)
        plain = pc.string_is_ascii(units).to_numpy(zero_copy_only=False) & ~apart
        starts, lengths = np.zeros(len(units) + 1, np.int64), np.ones(len(units) + 1, np.int64)
        pool, size = [np.array([end_id], np.uint32)], 1  # the last unit is the end
        starts[-1] = 0
        for chosen, encode in ((plain, self._plain), (~plain & ~apart, self._others), (apart, self._apart)):
            if chosen.any():
                ids, counts = encode(units.filter(pa.array(chosen)))
                starts[:-1][chosen], lengths[:-1][chosen] = size + np.cumsum(counts) - counts, counts
                pool.append(ids)
                size += len(ids)
        flat = np.insert(coded.indices.to_numpy(), inside, len(units))
        ends = np.concatenate([[0], np.cumsum(lengths[flat])])[inside + np.arange(1, len(texts) + 1)]
        return np.concatenate(pool)[spread_index(starts[flat], lengths[flat])], np.diff(ends, prepend=0)


def strings(texts: pa.Array) -> list[str]:
    """Texts without spaces as a list."""
    every = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    return pc.binary_join(every, " ")[0].as_py().split(" ") if len(texts) else []


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordTokens:
    return WordTokens(path)


def tokenized_pieces(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """A row per piece of at most ``capacity`` tokens: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``ids``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in in_chunks(batches, 1, CHUNK_CHARS):
            ids, counts = load(path).encode_batch(texts, end_id)
            pieces = -(-counts // capacity)
            place = spread_index(np.zeros(len(counts), np.int64), pieces)
            first = np.repeat(np.cumsum(counts) - counts, pieces) + place * capacity
            length = np.minimum(capacity, np.repeat(counts, pieces) - place * capacity)
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
            columns = [
                rows.column(0).take(pa.array(np.repeat(np.arange(len(counts)), pieces))),
                pa.array(place, pa.int32()),
                pa.array(place * capacity, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            if with_ids:
                edges = np.concatenate([first, [len(ids)]])
                columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32))))
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])
        # The file stays loaded, what was looked up ends with the partition.
        load(path).forget()

    kind = docs.schema[id_column].dataType.simpleString()
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return chosen.mapInArrow(releasing(run), schema).withColumnRenamed("id", id_column)


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Lengths, largest first, in groups of equal cardinality: (rounded size, runs of [length, first rank, number])."""
    total = sum(counts.values())
    share = -(-total // groups) if total else 0
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = share
            take = min(room, left)
            out[-1][1].append([length, rank, take])
            rank, left, room = rank + take, left - take, room - take
    merged: dict[int, list[list[int]]] = {}
    for size, runs in out:
        merged.setdefault(size, []).extend(runs)
    return list(merged.items())


def best_filling(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How many of each size fill ``room`` as far as possible, with no more of a size than are left."""
    reached = np.full(room + 1, -1, np.int64)  # the last size added to come to a sum
    reached[0] = len(sizes)
    for i, size in enumerate(sizes):
        for _ in range(min(left[i], room // size)):
            new = np.flatnonzero((reached[: room + 1 - size] >= 0) & (reached[size:] < 0))
            if not len(new):
                break
            reached[new + size] = i
        if reached[room] >= 0:
            break
    used, at = [0] * len(sizes), int(np.flatnonzero(reached >= 0)[-1])
    while at:
        i = int(reached[at])
        used[i] += 1
        at -= sizes[i]
    return used


def configurations(sizes: list[int], demand: list[int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """Ways to fill a sequence with few sizes (largest first), and how often each is used, until demand is met."""
    left = list(demand)
    for i, size in enumerate(sizes):
        while left[i]:
            left[i] -= 1
            used = best_filling(sizes[i:], left[i:], capacity - size)
            left[i] += 1
            used[0] += 1
            used = [0] * i + used
            times = min(n // u for n, u in zip(left, used, strict=True) if u)
            left = [n - u * times for n, u in zip(left, used, strict=True)]
            yield used, times


def packing_runs(counts: dict[int, int], capacity: int, groups: int, large_share: float) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, number, first sequence, pieces per sequence, offset), and the number of sequences."""
    limit = int(capacity * large_share)
    grouped = linear_groups({k: n for k, n in counts.items() if k > limit}, groups)
    queues = [runs for _, runs in grouped]
    out: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[list[int]]] = {}  # by what is left: sequences [first, number]
    sequences = 0
    for used, times in configurations([s for s, _ in grouped], [sum(r[2] for r in q) for q in queues], capacity):
        slots = [queue for queue, n in zip(queues, used, strict=True) for _ in range(n)]
        cut = [[] for _ in slots]
        for slot, queue in zip(cut, slots, strict=True):
            need = times
            while need:
                run = queue[0]
                take = min(need, run[2])
                slot.append((run[0], run[1], take))
                run[1], run[2], need = run[1] + take, run[2] - take, need - take
                if not run[2]:
                    queue.pop(0)
        edges = sorted({0, *(e for slot in cut for e in np.cumsum([r[2] for r in slot]).tolist())})
        offsets = dict.fromkeys(edges[:-1], 0)
        for slot in cut:
            at = 0
            for length, rank, number in slot:
                inside = edges[bisect_left(edges, at) : bisect_left(edges, at + number) + 1]
                for a, b in zip(inside[:-1], inside[1:], strict=True):
                    out.append((length, rank + a - at, b - a, sequences + a, 1, offsets[a]))
                    offsets[a] += length
                at += number
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            room.setdefault(capacity - offsets[a], []).append([sequences + a, b - a])
        sequences += times
    kinds = sorted(room)
    for length in sorted((k for k in counts if k <= limit), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(kinds, length)
            if at == len(kinds):
                new = -(-left // (capacity // length))
                room[capacity] = [[sequences, new]]
                kinds.append(capacity)
                sequences += new
            free = kinds[at]
            first, number = room[free].pop()
            if not room[free]:
                del room[free], kinds[at]
            each = free // length
            full = min(number, left // each)
            for begin, n, per in ((first, full, each), (first + full, int(full < number), left - full * each)):
                if n:
                    per = min(per, each)
                    if per:
                        out.append((length, rank, n * per, begin, per, capacity - free))
                        rank, left = rank + n * per, left - n * per
                    _put(room, kinds, free - per * length, [begin, n])
            if number > full + 1:
                _put(room, kinds, free, [first + full + 1, number - full - 1])
    return np.array(sorted(out), np.int64).reshape(-1, 6), sequences


def _put(room: dict[int, list[list[int]]], kinds: list[int], free: int, run: list[int]) -> None:
    if free not in room:
        room[free] = []
        insort(kinds, free)
    room[free].append(run)


def packed(
    pieces: DataFrame,
    order: list[str],
    capacity: int = CAPACITY,
    settings: tuple[tuple[int, float], ...] = SETTINGS,
) -> DataFrame:
    """``pieces`` (a stored table with ``length``) plus ``sequence_id`` and ``offset``; ``order`` tells rows apart."""
    found = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per length up to the capacity
    counts = {r["length"]: r["n"] for r in found}
    runs, _ = min((packing_runs(counts, capacity, *s) for s in settings), key=lambda plan: plan[1])
    keys = (runs[:, 0] << 44) + runs[:, 1]
    names = [*pieces.columns, "sequence_id", "offset"]
    at = names.index("length")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(at).to_numpy()
            rank = batch.column(batch.num_columns - 1).to_numpy()
            run = runs[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            sequence = run[:, 3] + nth // run[:, 4]
            offset = run[:, 5] + nth % run[:, 4] * length
            columns = [*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    ranked = salted_rank(pieces, ["length"], order, "__rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*pieces.columns, F.col("__rank").cast("long")).mapInArrow(
        releasing(place), schema + ", sequence_id long, offset long"
    )


def sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id`` and the ``ids`` of its pieces laid end to end; no more than the capacity meet in a group."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their place, without the ids themselves."""
    pieces = scratch(tokenized_pieces(docs, path, capacity, end_id, with_ids=False), "pieces")
    return packed(pieces, ["doc_id", "piece", "ids_crc32"], capacity)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
