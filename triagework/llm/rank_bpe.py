"""Byte-level BPE by ranks, run as recursive queries of an in-memory DuckDB inside each partition.

A text is cut into pieces by the tokenizer's pattern. The distinct pieces of a run of texts become words of byte tokens;
a recursive query joins each word's neighbouring tokens with the merge table, contracts the word's leftmost pair of least
rank, and goes on with the words that changed until none does. A piece that is a token itself is that token. Ids are
ranks, as in a file of base64 tokens and ranks. Decoding joins ids with the vocabulary and puts the tokens of a text
together by an ordered aggregation.

Pieces of more than ``LONG_BYTES`` bytes are first cut where no token of the vocabulary crosses; a cut there changes
nothing. What is still longer takes a query whose rows are single tokens. There a step contracts at once what one pair at
a time would contract in the end as well: the word's pairs of least rank, every second one of overlapping pairs, up to
the first whose merged token could take part in a lower merge with what stands beside it; and every pair whose two tokens
no lower merge can take away. What could stand beside a token is judged by its edge byte, which merges do not change.

Words between spaces that a partition saw before are looked up; the lookup table ends with the partition, is emptied
at ``REMEMBERED`` words and only saves time. The database spills nothing to disk.

Null and empty texts have no tokens, and null or empty ids decode to no bytes. Special tokens written in a text are
ordinary text. Ids outside the vocabulary are an error. Rows are independent, so repeated rows repeat and no rows give
no rows; other columns are not read. The vocabulary file must be on every machine.
"""

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import Self

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.llm.common import in_chunks, read_table, spread_index

REMEMBERED = 400_000
LONG_BYTES = 64

#: Texts that single spaces part into words, whatever else white space is taken to be.
EVEN = re.compile(r"[^\s\x00-\x20]+(?: [^\s\x00-\x20]+)*")

#: Two numbers in one, so that the least rank and, among equals, the leftmost place are one minimum.
SHIFT = 1 << 32

#: Words as lists of tokens: neighbours are unnested, and the best pair of each word is contracted.
CONTRACT_WORDS = f"""
WITH RECURSIVE state(word, tokens) USING KEY (word) AS (
    SELECT word, tokens FROM words
    UNION ALL
    (
        WITH pairs AS (
            SELECT word, unnest(tokens[:-2]) * {SHIFT}::BIGINT + unnest(tokens[2:]) AS pair,
                generate_subscripts(tokens[2:], 1) AS place
            FROM state
        ), best AS (
            SELECT word, min(merged * {SHIFT}::BIGINT + place) AS best
            FROM pairs JOIN merges USING (pair)
            GROUP BY word
        )
        SELECT word,
            list_concat(list_append(tokens[: best % {SHIFT} - 1], (best // {SHIFT})::INTEGER), tokens[best % {SHIFT} + 2 :])
        FROM state JOIN best USING (word)
    )
)
SELECT word, tokens FROM state ORDER BY word
"""

#: Words as one row per token; a token that was merged into the one before it is kept as -1 and read no more. ``byte`` is
#: the byte at ``pos``, ``byte_before`` the one before it: neither changes when tokens are merged.
CONTRACT_ROWS = f"""
WITH RECURSIVE state(word, pos, token, byte, byte_before) USING KEY (word, pos) AS (
    SELECT word, pos, token, byte, byte_before FROM starts
    UNION ALL
    (
        WITH live AS MATERIALIZED (
            SELECT *, lead(pos) OVER neighbours AS next_pos, lead(token) OVER neighbours AS next_token,
                lead(byte, 2) OVER neighbours AS byte_after, row_number() OVER neighbours AS place
            FROM state WHERE token >= 0
            WINDOW neighbours AS (PARTITION BY word ORDER BY pos)
        ), pairs AS (
            SELECT live.*, merges.merged,
                coalesce(merges.merged < left_of_new.merged, true) AND coalesce(merges.merged < right_of_new.merged, true)
                    AS calm,
                calm AND coalesce(merges.merged < left_of_pair.merged, true)
                    AND coalesce(merges.merged <= right_of_pair.merged, true) AS settled
            FROM live JOIN merges ON pair = token * {SHIFT}::BIGINT + next_token
            LEFT JOIN low_left AS left_of_pair ON left_of_pair.byte = byte_before AND left_of_pair.token = live.token
            LEFT JOIN low_right AS right_of_pair ON right_of_pair.byte = byte_after AND right_of_pair.token = next_token
            LEFT JOIN low_left AS left_of_new ON left_of_new.byte = byte_before AND left_of_new.token = merges.merged
            LEFT JOIN low_right AS right_of_new ON right_of_new.byte = byte_after AND right_of_new.token = merges.merged
        ), best AS (
            SELECT word, min(merged) AS merged FROM pairs GROUP BY word
        ), hits AS (
            SELECT pairs.word, pairs.pos, next_pos, place, pairs.merged,
                coalesce(bool_and(calm) OVER (PARTITION BY pairs.word ORDER BY place
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS undisturbed,
                place - row_number() OVER (PARTITION BY pairs.word ORDER BY place) AS stretch
            FROM pairs JOIN best USING (word, merged)
        ), chosen AS MATERIALIZED (
            SELECT word, pos, next_pos, merged
            FROM hits
            QUALIFY undisturbed AND row_number() OVER (PARTITION BY word, stretch ORDER BY place) % 2 = 1
            UNION
            SELECT word, pos, next_pos, merged FROM pairs WHERE settled
        )
        SELECT live.word, live.pos, CASE
            WHEN kept.merged IS NOT NULL THEN kept.merged
            WHEN gone.merged IS NOT NULL THEN -1
            ELSE live.token END, live.byte, live.byte_before
        FROM live SEMI JOIN best USING (word)
        LEFT JOIN chosen AS kept ON live.word = kept.word AND live.pos = kept.pos
        LEFT JOIN chosen AS gone ON live.word = gone.word AND live.pos = gone.next_pos
    )
)
SELECT word, list(token ORDER BY pos) AS tokens FROM state WHERE token >= 0 GROUP BY word ORDER BY word
"""

#: Least rank of a merge with this second token whose first token ends with this byte, and the like to the right.
LOW_RANKS = (
    """CREATE TABLE low_left AS
    SELECT last_byte AS byte, second_token AS token, min(merged) AS merged
    FROM merges JOIN vocabulary ON id = first_token GROUP BY ALL""",
    """CREATE TABLE low_right AS
    SELECT first_byte AS byte, first_token AS token, min(merged) AS merged
    FROM merges JOIN vocabulary ON id = second_token GROUP BY ALL""",
)

JOIN_TOKENS = """
SELECT doc, string_agg(characters, '' ORDER BY pos) AS characters
FROM coded JOIN vocabulary USING (id)
GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Numbers(dict):
    """Numbers of strings in the order of their first lookup; ``fresh`` lists those that were new."""

    def __init__(self, fresh: list[str], first: int = 0, lead: str = "") -> None:
        super().__init__()
        self.fresh, self.first, self.lead = fresh, first, lead

    def __missing__(self, string: str) -> int:
        self[string] = number = self.first + len(self.fresh)
        self.fresh.append(self.lead + string)
        return number


def in_order(strings: Iterable[str], numbers: Numbers, size: int) -> np.ndarray:
    return np.fromiter(map(numbers.__getitem__, strings), np.int64, size)


class Runs:
    """Runs of ids, one after the other in a pool that grows."""

    def __init__(self) -> None:
        self.ids, self.starts, self.lengths = (np.zeros(0, kind) for kind in (np.int32, np.int64, np.int64))

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        return self.ids[spread_index(self.starts[numbers], self.lengths[numbers])]


def uneven(text: str) -> bool:
    """Whether white space other than single spaces between words is in a text, or might be."""
    return EVEN.fullmatch(text) is None


class RankBpe:
    """Vocabulary and merges in a database of this object's own; closed at the end of ``with``."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        self.ranks = read_ranks(path)
        self.pieces = regex.compile(pattern).findall
        # What a word holds never depends on what stands beyond its spaces.
        self.words = regex.compile(r" ?\S+|\s+(?!\S)|\s+").findall
        self.longest = max(map(len, self.ranks), default=0)
        size = max(self.ranks.values(), default=-1) + 1
        self.known = np.zeros(size, bool)
        self.known[list(self.ranks.values())] = True
        self.byte_ranks = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        rows = [
            (a, b, merged)
            for token, merged in self.ranks.items()
            for i in range(1, len(token))
            if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None
        ]
        first, second, merged = np.array(rows, np.int32).reshape(-1, 3).T
        pair = first.astype(np.int64) * SHIFT + second
        merges = pa.table([pair, first, second, merged], ["pair", "first_token", "second_token", "merged"])
        characters = [token.decode("latin-1") for token in self.ranks]
        edges = [pa.array([token[i] for token in self.ranks], pa.int16()) for i in (0, -1)]
        vocabulary = pa.table(
            [pa.array(self.ranks.values(), pa.int32()), characters, *edges], ["id", "characters", "first_byte", "last_byte"]
        )
        self.database = duckdb.connect(
            ":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": "", "max_temp_directory_size": "0B"}
        )
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.database.register("given", table)
            self.database.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.database.unregister("given")
        for statement in LOW_RANKS:
            self.database.execute(statement)
        self.forget()

    def __enter__(self) -> Self:
        return self

    def __exit__(self, *_: object) -> None:
        self.database.close()

    def forget(self) -> None:
        self.fresh_words: list[str] = []
        self.fresh_pieces: list[str] = []
        self.edge_words, self.spaced_words = Numbers(self.fresh_words), Numbers(self.fresh_words, lead=" ")
        self.piece_numbers = Numbers(self.fresh_pieces)
        self.word_runs, self.piece_runs = Runs(), Runs()

    def _query(self, sql: str, name: str, table: pa.Table) -> pa.Table:
        self.database.register(name, table)
        found = self.database.sql(sql).to_arrow_table()
        self.database.unregister(name)
        return found

    def _contracted(self, words: list[bytes], by_row: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lengths = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        tokens = self.byte_ranks[data]
        ends = np.cumsum(lengths)
        numbers = np.arange(len(words), dtype=np.int32)
        if by_row:
            places = np.arange(len(tokens)) - np.repeat(ends - lengths, lengths)
            before = np.where(places > 0, np.concatenate([[0], data[:-1]]), -1).astype(np.int16)
            columns = [np.repeat(numbers, lengths), places.astype(np.int32), tokens, data.astype(np.int16), before]
            table = pa.table(columns, ["word", "pos", "token", "byte", "byte_before"])
            found = self._query(CONTRACT_ROWS, "starts", table)
        else:
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(tokens))
            found = self._query(CONTRACT_WORDS, "words", pa.table([numbers, lists], ["word", "tokens"]))
        column = found["tokens"].combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy().astype(np.int64)

    def cut_apart(self, piece: bytes) -> list[bytes]:
        """Parts of a piece between places that no token of the vocabulary found in it crosses."""
        out, start, reach = [], 0, 1
        for at in range(len(piece)):
            if at >= reach:
                out.append(piece[start:at])
                start = at
            for size in range(min(self.longest, len(piece) - at), 1, -1):
                if at + size <= reach:
                    break
                if piece[at : at + size] in self.ranks:
                    reach = at + size
                    break
            reach = max(reach, at + 1)
        return [*out, piece[start:]]

    def encode_pieces(self, pieces: list[bytes]) -> Runs:
        """Ids of each piece."""
        parts: list[bytes] = []
        parts_of, whole = [], {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                whole[i] = rank
                parts_of.append(0)
            else:
                cut = [piece] if len(piece) <= LONG_BYTES else self.cut_apart(piece)
                parts += cut
                parts_of.append(len(cut))
        long = np.array([len(p) > LONG_BYTES for p in parts], bool)
        ids, lengths = self._contracted([p for p in parts if len(p) <= LONG_BYTES], False)
        more, more_lengths = self._contracted([p for p in parts if len(p) > LONG_BYTES], True)
        # Runs are parts in the order of their queries, then whole pieces; a piece is what its parts are.
        runs = Runs()
        runs.add(ids, lengths)
        runs.add(more, more_lengths)
        runs.add(np.array(list(whole.values()), np.int32), np.ones(len(whole), np.int64))
        order = np.zeros(len(parts) + len(whole), np.int64)
        order[: len(parts)][~long] = np.arange(len(lengths))
        order[: len(parts)][long] = len(lengths) + np.arange(len(more_lengths))
        order[len(parts) :] = len(parts) + np.arange(len(whole))
        counts = np.array(parts_of, np.int64)
        starts = np.cumsum(counts) - counts
        counts[list(whole)], starts[list(whole)] = 1, len(parts) + np.arange(len(whole))
        chosen = order[spread_index(starts, counts)]
        sizes = np.add.reduceat(np.append(runs.lengths[chosen], 0), np.cumsum(counts) - counts) if len(counts) else counts
        out = Runs()
        out.add(runs.joined(chosen), sizes)
        return out

    def _learn(self) -> None:
        """Add the runs of the words, and of their pieces, that were looked up for the first time."""
        # Most words are letters after a space or none: one piece.
        pieces_of = [
            [word] if word.isascii() and (word[1:] if word[0] == " " else word).isalpha() else self.pieces(word)
            for word in self.fresh_words
        ]
        counts = np.array([len(p) for p in pieces_of], np.int64)
        flat = in_order((p for row in pieces_of for p in row), self.piece_numbers, int(counts.sum()))
        new = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in self.fresh_pieces])
        self.piece_runs.add(new.ids, new.lengths)
        sums = np.concatenate([[0], np.cumsum(self.piece_runs.lengths[flat])])
        ends = np.concatenate([[0], np.cumsum(counts)])
        self.word_runs.add(self.piece_runs.joined(flat), np.diff(sums[ends]))
        for numbers in (self.edge_words, self.spaced_words):
            numbers.first += len(self.fresh_words)
        self.piece_numbers.first += len(self.fresh_pieces)
        self.fresh_words.clear()
        self.fresh_pieces.clear()

    def _words(self, text: str) -> np.ndarray:
        """Numbers of a text's words."""
        if uneven(text):
            words = self.words(text)
            return in_order(words, self.edge_words, len(words))
        first, *others = text.split(" ")
        return np.append(self.edge_words[first], in_order(others, self.spaced_words, len(others)))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many belong to each text."""
        if len(self.edge_words) + len(self.spaced_words) > REMEMBERED or len(self.piece_numbers) > REMEMBERED:
            self.forget()
        rows = [self._words(t) if t else np.zeros(0, np.int64) for t in texts]
        if self.fresh_words:
            self._learn()
        flat = np.concatenate([np.zeros(0, np.int64), *rows])
        sums = np.concatenate([[0], np.cumsum(self.word_runs.lengths[flat])])
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
        return self.word_runs.joined(flat), np.diff(sums[ends])

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of ids laid end to end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        out = [b""] * len(counts)
        if not len(ids):
            return out
        docs = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        table = pa.table([docs, np.arange(len(ids), dtype=np.int32), ids.astype(np.int32)], ["doc", "pos", "id"])
        found = self._query(JOIN_TOKENS, "coded", table)
        for doc, characters in zip(found["doc"].to_pylist(), found["characters"].to_pylist(), strict=True):
            out[doc] = characters.encode("latin-1")
        return out


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``ids``, the tokens of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with RankBpe(path) as bpe:
            for rows, texts in in_chunks(batches, 1):
                ids, counts = bpe.encode_batch(texts)
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists], ["id", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column`` and ``bytes``; ids need not end at a character's end, so the bytes need not be text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with RankBpe(path) as bpe:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    rows = batch.slice(at, 256)
                    counts = pc.fill_null(pc.list_value_length(rows.column(1)), 0).to_numpy(zero_copy_only=False)
                    ids = rows.column(1).flatten().to_numpy(zero_copy_only=False)
                    found = bpe.decode_batch(ids, counts.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.binary())], ["id", "bytes"])

    kind = encoded.schema[id_column].dataType.simpleString()
    chosen = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).cast("array<int>").alias("ids"))
    return chosen.mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_column)


def round_trips(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode, decode, and keep digests only: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with RankBpe(path) as bpe:
            for rows, texts in in_chunks(batches, 1):
                ids, counts = bpe.encode_batch(texts)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), (4 * np.cumsum(counts)).tolist()
                ids_sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                text_sha = [hashlib.sha256(t).hexdigest() for t in bpe.decode_batch(ids, counts)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    out = chosen.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_column)


def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
