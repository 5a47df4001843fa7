"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

A text is cut into pieces by the tokenizer's pattern. Inside a piece, an Aho-Corasick automaton gives the longest token
at each place. Tokens are taken left to right; a token may follow another only if merging the bytes of both by rank
would keep them apart, which a table of checked pairs answers. A token that fits nothing gives way to the longest
shorter one, and a place from which nothing fits is never tried again, so a piece takes time linear in its length.
Units between spaces that were seen before are looked up; the lookup table is bounded and only saves time.

Null and empty texts have no tokens; decoding no tokens gives an empty text. Special tokens written in a text become
their own id, as the tokenizers library does. Rows are independent, so repeated rows repeat and no rows give no rows;
other columns are not read.
"""

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.llm.common import in_chunks, read_table, spread_index

#: Units remembered by a worker.
REMEMBERED = 600_000

#: White space beyond spaces and line feeds, and a space beside any white space.
OTHER_SPACE = re.compile(r"[^\S \n]")
UNEVEN_SPACE = re.compile(r" \s|\s ")


def char_of_byte() -> list[str]:
    """Byte-level tokenizers write printable Latin-1 bytes as themselves, the others as characters from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Runs(dict):
    """Numbers of units; a unit that is new is learned when it is looked up."""

    def __init__(self, learn: Callable[[str], int]) -> None:
        super().__init__()
        self.learn = learn

    def __missing__(self, unit: str) -> int:
        number = self.learn(unit)
        if len(unit) < 64:
            self[unit] = number
        return number


def uneven(text: str) -> bool:
    """Whether a space is beside other white space or an edge: there a unit's pieces depend on its neighbours."""
    if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
        return True
    return OTHER_SPACE.search(text) is not None and UNEVEN_SPACE.search(text) is not None


class ByteBpe:
    """A byte-level vocabulary; inside, tokens go by rank: bytes first, then merges in their order."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = {c: b for b, c in enumerate(char_of_byte())}
        raw = lambda token: bytes(to_byte[c] for c in token)
        vocabulary = spec["model"]["vocab"]
        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.first, self.second = list(range(256)), list(range(256))
        self.pairs: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            a, b = map(raw, merge if isinstance(merge, list) else merge.split(" "))
            rank = len(self.first)
            ranks.setdefault(a + b, rank)
            self.pairs[ranks[a], ranks[b]] = rank
            self.first.append(ranks[a])
            self.second.append(ranks[b])
        tokens = [bytes([b]) for b in range(256)] + [b""] * (len(self.first) - 256)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = [len(t) for t in tokens]
        written = {raw(t): i for t, i in vocabulary.items() if all(c in to_byte for c in t)}
        self.ids = [written.get(t, -1) for t in tokens]
        self.automaton = ahocorasick.Automaton()
        self.by_text = {t.decode("latin-1"): r for r, t in enumerate(tokens) if t}
        for token, rank in self.by_text.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.tokens = tokens
        self.shorter: dict[int, int] = {}
        self.checked: dict[tuple[int, int], bool] = {}

        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.pieces = regex.compile(pattern).findall
        texts = written | {s.encode(): i for s, i in self.special.items()}
        by_id = {i: t for t, i in texts.items()}
        in_order = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.blob = np.frombuffer(b"".join(in_order), np.uint8)
        self.offsets = np.array([0, *accumulate(map(len, in_order))], np.int64)
        self.decimals = [str(i) for i in range(len(in_order))]
        self.forget()

    def forget(self) -> None:
        self.after_space = Runs(lambda unit: self._learn(" " + unit))
        self.without_space = Runs(self._learn)
        self.known_pieces: dict[str, list[int]] = {}
        self.runs = array("q", [0])
        self.pool = array("i")

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps these neighbours as they are.

        The later formed of the two is undone step by step; a merge across the border that ranks before what was undone
        would have happened first.
        """
        key = (left, right)
        if (known := self.checked.get(key)) is not None:
            return known
        limit, fits = len(self.first) + 1, True
        while True:
            across = self.pairs.get((left, right))
            if across is not None and across < limit:
                fits = False
                break
            if left < 256 and right < 256:
                break
            if left > right:
                limit, left = left, self.second[left]
            else:
                limit, right = right + 1, self.first[right]
        if len(self.checked) > 2_000_000:
            self.checked.clear()
        self.checked[key] = fits
        return fits

    def shortened(self, token: int) -> int:
        """Longest other token that this one begins with, or -1."""
        if (found := self.shorter.get(token)) is None:
            text = self.tokens[token].decode("latin-1")
            found = next((r for n in range(len(text) - 1, 0, -1) if (r := self.by_text.get(text[:n])) is not None), -1)
            self.shorter[token] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ranks of a piece's tokens."""
        if not piece:
            return []
        text, lengths, n = piece.decode("latin-1"), self.lengths, len(piece)
        longest = [0] * n
        for end, rank in self.automaton.iter(text):
            longest[end + 1 - lengths[rank]] = rank
        taken: list[int] = []
        dead, at, token = set(), 0, longest[0]
        while True:
            while token >= 0 and (
                at + lengths[token] in dead or (taken and not self.compatible(taken[-1], token))
            ):
                token = self.shortened(token)
            if token < 0:
                dead.add(at)
                token = taken.pop()
                at -= lengths[token]
                continue
            taken.append(token)
            at += lengths[token]
            if at == n:
                return taken
            token = longest[at]

    def _piece_ids(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            ids = self.known_pieces.get(piece)
            if ids is None:
                ids = [self.ids[r] for r in self.encode_piece(piece.encode("utf-8", "surrogatepass"))]
                if len(piece) < 64 and len(self.known_pieces) < REMEMBERED:
                    self.known_pieces[piece] = ids
            out += ids
        return out

    def _learn(self, text: str) -> int:
        return self._add(self._piece_ids(text))

    def _add(self, ids: list[int]) -> int:
        self.pool.extend(ids)
        self.runs.append(len(self.pool))
        return len(self.runs) - 2

    def _units(self, text: str) -> list[int]:
        """Numbers of the runs in the pool that make up a text."""
        if self.special and any(s in text for s in self.special):
            out, at = [], 0
            for found in self.special_cut.finditer(text):
                out += self._units(text[at : found.start()])
                out.append(self._add([self.special[found[0]]]))
                at = found.end()
            return out + self._units(text[at:])
        if not text:
            return []
        if uneven(text):
            return [self._learn(text)]
        head, *tail = text.split(" ")
        return [self.without_space[head], *map(self.after_space.__getitem__, tail)]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many belong to each text."""
        if len(self.runs) > REMEMBERED:
            self.forget()
        units = [self._units(t or "") for t in texts]
        runs = np.frombuffer(self.runs, np.int64)
        flat = np.fromiter((u for row in units for u in row), np.int64, sum(map(len, units)))
        starts, lengths = runs[flat], runs[flat + 1] - runs[flat]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.diff(ends[np.concatenate([[0], np.cumsum([len(u) for u in units])]).astype(np.int64)])
        return np.frombuffer(self.pool, np.int32)[spread_index(starts, lengths)], counts

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids laid end to end."""
        starts = self.offsets[ids]
        lengths = self.offsets[ids.astype(np.int64) + 1] - starts
        data = self.blob[spread_index(starts, lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``ids``, the tokens of each text. The vocabulary file must be on every machine."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in in_chunks(batches, 1):
            ids, counts = load(path).encode_batch(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists], ["id", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column`` and ``text``; null ids give an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                counts = pc.fill_null(pc.list_value_length(rows.column(1)), 0).to_numpy(zero_copy_only=False)
                ids = rows.column(1).flatten().to_numpy(zero_copy_only=False)
                texts = load(path).decode_batch(ids, counts.astype(np.int64))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    chosen = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).cast("array<int>").alias("ids"))
    return chosen.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)


def round_trips(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode, decode, and keep digests only: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        written = bpe.decimals.__getitem__
        for rows, texts in in_chunks(batches, 1):
            ids, counts = bpe.encode_batch(texts)
            plain, ends = ids.tolist(), np.cumsum(counts).tolist()
            ids_sha = [
                hashlib.sha256(",".join(map(written, plain[a:b])).encode()).hexdigest()
                for a, b in zip([0, *ends[:-1]], ends, strict=True)
            ]
            del plain
            text_sha = [hashlib.sha256(t.encode()).hexdigest() for t in bpe.decode_batch(ids, counts)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    out = chosen.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_column)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
