"""Class-based n-gram language model: exchange clustering, class transitions and word emissions.

The most frequent words are units of their own; all other words are units by their ending, so the number of units is a
parameter and every word has a class. Exchange clustering moves a unit to the class in which the likelihood of the
class bigrams is highest. Each sweep counts, over all training tokens, how often a unit is followed and preceded by each
class; tasks count into one dense matrix before anything is shuffled, and only that matrix (units times classes,
whatever the corpus size) reaches the driver, which makes the moves. The classes of the best sweep are kept.

A text's probability is the product, over its words and one end, of transition P(class | class before) and emission
P(word | class); the text starts after an end. Transitions are mixed with class frequencies, an emission within a unit
of several words adds one to all counts and leaves one share to unknown words, so probabilities sum to at most one.

Counts of frequent words are broadcast (``Settings.listed`` words at most). The counts of all others, which grow with the corpus,
meet the texts in a join of (text, word) pairs, made distinct before.

Null and empty texts are one end token. Rows with a null id are in the fold of an empty id. Repeated rows get equal
scores. With no training rows the base score is 0 and all words are unknown. No rows give no rows; other columns are
not read.
"""

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.llm.common import crc_fold, in_chunks, lowered, read_table, scratch

#: Units that are summed up together, and distinct words a task counts before it passes them on.
BLOCK = 32
COUNTED_AT_ONCE = 300_000
ENDING_BYTES = 3


@dataclass(frozen=True)
class Settings:
    """Sizes of the model; none depends on the corpus."""

    listed: int = 49_152  # words whose counts are broadcast
    own_units: int = 8_192  # words that are units of their own
    endings: int = 2_048
    classes: int = 48
    sweeps: int = 10
    prior: float = 20.0  # weight of class frequencies in a transition


def ending_of(word: bytes, endings: int) -> int:
    return zlib.crc32(word[-ENDING_BYTES:]) % endings


def ending_column(word: Column, endings: int) -> Column:
    return (F.crc32(F.substring(word, -ENDING_BYTES, ENDING_BYTES)) % F.lit(endings)).cast("int")


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (UTF-8 bytes) and ``n`` of a table with a column ``text``; counted per task before the shuffle."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for _, rows in in_chunks(batches, 0):
            for text in rows:
                found.update(lowered(text).split())
            if len(found) > COUNTED_AT_ONCE:
                yield _counted(found)
                found.clear()
        if found:
            yield _counted(found)

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"]
    )


@dataclass
class Lexicon:
    """Ids of tokens: 0 the end, then endings of unlisted words, then listed words, the most frequent first."""

    settings: Settings
    words: list[bytes]
    counts: np.ndarray  # of listed words
    ends: int  # training texts
    total: int  # training tokens
    distinct: int
    ending_tokens: np.ndarray  # of words that are no unit of their own, by ending
    ending_words: np.ndarray

    def __post_init__(self) -> None:
        self.first = 1 + self.settings.endings
        own = min(self.settings.own_units, len(self.words))
        self.units = self.first + own
        ids = np.arange(self.first + len(self.words))
        ids[self.units :] = [1 + ending_of(w, self.settings.endings) for w in self.words[own:]]
        self.unit_of = ids


def lexicon(vocabulary: DataFrame, ends: int, settings: Settings) -> Lexicon:
    """From the stored counts of all words; at most ``listed`` words and a row per ending reach the driver."""
    level = F.floor(F.log2("n") * 64)
    levels = sorted(vocabulary.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    least, words = None, 0
    for at, n in levels:
        if words + n > settings.listed:
            break
        least, words = at, words + n
    found = vocabulary.where(level >= F.lit(least)).collect() if least is not None else []
    found = sorted(((r["n"], bytes(r["word"])) for r in found), key=lambda r: (-r[0], r[1]))
    listed = [w for _, w in found]
    counts = np.array([n for n, _ in found], np.int64)
    tokens, kinds = np.zeros(settings.endings, np.int64), np.zeros(settings.endings, np.int64)
    by_ending = vocabulary.groupBy(ending_column(F.col("word"), settings.endings).alias("e")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")
    )
    for e, n, k in by_ending.collect():
        tokens[e], kinds[e] = n, k
    own = settings.own_units
    for word, n in zip(listed[:own], counts[:own].tolist(), strict=True):
        tokens[ending_of(word, settings.endings)] -= n
        kinds[ending_of(word, settings.endings)] -= 1
    total, distinct = vocabulary.agg(F.sum("n"), F.count(F.lit(1))).first()
    return Lexicon(settings, listed, counts, ends, (total or 0) + ends, distinct + (ends > 0), tokens, kinds)


def coded(rows: DataFrame, words: Lexicon) -> DataFrame:
    """Per row: ``ids`` of its tokens as bytes of unsigned 16-bit numbers, and its unlisted ``words`` with counts."""
    listed, first, endings = words.words, words.first, words.settings.endings

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: first + i for i, w in enumerate(listed)}
        for chunk, texts in in_chunks(batches, 0):
            ids, sizes, unlisted, times, edges = [], [], [], [], [0]
            for text in texts:
                found = lowered(text).split()
                here = list(map(known.get, found))
                rare = Counter([w for w, i in zip(found, here, strict=True) if i is None])
                if rare:
                    places = {w: 1 + ending_of(w, endings) for w in rare}
                    here = [places[w] if i is None else i for w, i in zip(found, here, strict=True)]
                here.append(0)
                ids.append(np.array(here, np.uint16).tobytes())
                sizes.append(len(here))
                unlisted += rare.keys()
                times += rare.values()
                edges.append(len(unlisted))
            pairs = pa.StructArray.from_arrays([pa.array(unlisted, pa.binary()), pa.array(times, pa.int32())], ["w", "n"])
            columns = [
                *chunk.columns[1:],
                pa.array(sizes, pa.int64()),
                pa.array(ids, pa.binary()),
                pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pairs),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_tokens", "ids", "words"])

    names = rows.columns[1:]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, n_tokens long, ids binary, words array<struct<w: binary, n: int>>")


def contexts(train: DataFrame, words: Lexicon, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per unit: tokens followed by each class, tokens preceded by each class, and tokens followed by the same unit."""
    unit_of, units, c = words.unit_of, words.units, words.settings.classes
    tasks = 4 * train.sparkSession.sparkContext.defaultParallelism

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((units, 2 * c + 1), np.int64)
        for batch in batches:
            unit = unit_of[np.frombuffer(b"\0\0" + b"".join(batch.column(0).to_pylist()), np.uint16)]
            here = classes[unit]
            table[:, :c] += np.bincount(unit[:-1] * c + here[1:], minlength=units * c).reshape(units, c)
            table[:, c : 2 * c] += np.bincount(unit[1:] * c + here[:-1], minlength=units * c).reshape(units, c)
            table[:, 2 * c] += np.bincount(unit[:-1][unit[:-1] == unit[1:]], minlength=units)
        starts = range(0, units, BLOCK)
        parts = [table[at : at + BLOCK].tobytes() for at in starts]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array(parts, pa.binary())], ["at", "counts"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p, np.int64) for p in parts["counts"].to_pylist())
        return pa.table({"at": parts["at"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    counted = train.select("ids").coalesce(tasks).mapInArrow(count, "at long, counts binary")
    table = np.zeros((units, 2 * c + 1), np.int64)
    for at, counts in counted.groupBy("at").applyInArrow(add, "at long, counts binary").collect():
        rows = np.frombuffer(bytes(counts), np.int64).reshape(-1, 2 * c + 1)
        table[at : at + len(rows)] = rows
    return table[:, :c], table[:, c : 2 * c], table[:, 2 * c]


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def class_bigrams(right: np.ndarray, classes: np.ndarray) -> np.ndarray:
    table = np.zeros((right.shape[1], right.shape[1]))
    np.add.at(table, classes, right)
    return table


def likelihood(bigrams: np.ndarray) -> float:
    return float(_f(bigrams).sum() - _f(bigrams.sum(axis=0)).sum() - _f(bigrams.sum(axis=1)).sum())


def exchanged(
    right: np.ndarray, left: np.ndarray, own: np.ndarray, classes: np.ndarray, active: np.ndarray
) -> np.ndarray:
    """Classes after each active unit went where the likelihood of the class bigrams is highest."""
    classes, n = classes.copy(), class_bigrams(right, classes)
    for u in active:
        a, s = classes[u], float(own[u])
        r, l = right[u].astype(float), left[u].astype(float)  # noqa: E741
        if not r.any() and not l.any():
            continue
        r[a] -= s
        l[a] -= s
        n[a] -= r
        n[:, a] -= l
        n[a, a] -= s
        np.maximum(n, 0, out=n)
        before = _f(n)
        gain = (_f(n + r) - before).sum(axis=1) + (_f(n + l[:, None]) - before).sum(axis=0)
        d = np.diagonal(n)
        gain += _f(d + r + l + s) - _f(d + r) - _f(d + l) + np.diagonal(before)
        rows, columns = n.sum(axis=1) + l, n.sum(axis=0) + r
        gain -= _f(rows + r.sum() + s) - _f(rows) + _f(columns + l.sum() + s) - _f(columns)
        gain[0] = -np.inf  # the end's own class
        b = int(np.argmax(gain))
        n[b] += r
        n[:, b] += l
        n[b, b] += s
        classes[u] = b
    return classes


def clustered(train: DataFrame, words: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every unit, class bigrams and tokens per unit, of the sweep with the highest likelihood."""
    units, sweeps = words.units, words.settings.sweeps
    classes = np.zeros(units, np.int64)
    size = np.concatenate([[0], words.ending_tokens, words.counts[: words.settings.own_units]])
    order = np.argsort(-size[1:], kind="stable") + 1
    classes[order] = 1 + np.arange(units - 1) % (words.settings.classes - 1)
    best = None
    for sweep in range(sweeps + 1):
        right, left, own = contexts(train, words, classes)
        bigrams = class_bigrams(right, classes)
        value = likelihood(bigrams)
        if best is None or value > best[0]:
            best = value, classes, bigrams, left.sum(axis=1)
        if sweep < sweeps:
            turn = order if sweep < 2 else order[sweep % 2 :: 2]
            classes = exchanged(right, left, own, classes, turn)
    return best[1], best[2], best[3]


def scored(
    docs: DataFrame,
    held_out: Column,
    settings: Settings = Settings(),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row of ``docs``: id, fold, token counts, ``base_score`` of smoothed word counts and ``score`` of the model."""
    text = F.col(text_column).cast("string")
    train = docs.where(~held_out).select(text.alias("text"))
    vocabulary = scratch(word_counts(train), "words")
    words = lexicon(vocabulary, docs.where(~held_out).count(), settings)
    rows = docs.select(text.alias("text"), F.col(id_column).alias("id"), held_out.alias("held_out"))
    sequences = scratch(coded(rows, words).withColumn("row", F.monotonically_increasing_id()), "sequences")
    classes, bigrams, tokens = clustered(sequences.where("not held_out"), words)

    frequency = (bigrams.sum(axis=0) + 1) / (bigrams.sum() + settings.classes)
    prior, first = settings.prior, words.first
    moves = np.log10((bigrams + prior * frequency) / (bigrams.sum(axis=1, keepdims=True) + prior))
    members = np.bincount(classes, minlength=settings.classes)
    in_class = np.bincount(classes, weights=tokens, minlength=settings.classes)
    of_unit = np.log10((tokens + 0.5) / (in_class + 0.5 * members)[classes])
    of_unit[0] = 0.0
    of_ending = -np.log10(words.ending_tokens + words.ending_words + 1.0)
    unit_of, own = words.unit_of, words.units
    emission = of_unit[unit_of]
    emission[1:first] += of_ending
    emission[own:] += of_ending[unit_of[own:] - 1] + np.log10(words.counts[settings.own_units :] + 1.0)
    whole = np.log10(words.total + words.distinct + 1.0)
    base = np.full(len(unit_of), -whole)
    base[0] += np.log10(words.ends + 1.0)
    base[first:] += np.log10(words.counts + 1.0)
    class_of, ends_known = classes[unit_of], words.ends > 0

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, sizes = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ids = np.frombuffer(b"\0\0" + b"".join(data), np.uint16)
            c = class_of[ids]
            starts = np.cumsum(sizes) - sizes
            sums = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]  # noqa: E731, B023
            known = (ids[1:] >= first) | ((ids[1:] == 0) & ends_known)
            columns = [
                *batch.columns[1:],
                pa.array(sums(known.astype(np.int64)), pa.int64()),
                pa.array(sums(base[ids[1:]]), pa.float64()),
                pa.array(sums(moves[c[:-1], c[1:]] + emission[ids[1:]]), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["n_tokens", "row", "id", "held_out", "known", "base", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    local = sequences.select("ids", "n_tokens", "row", "id", "held_out").mapInArrow(
        score, f"n_tokens long, row long, id {kind}, held_out boolean, known long, base double, score double"
    )
    pairs = sequences.select("row", F.explode("words").alias("p")).select("row", F.col("p.w").alias("word"), "p.n")
    counts = vocabulary.select(F.col("word").alias("v_word"), F.col("n").alias("count"))
    seen = pairs.join(counts, F.col("word") == F.col("v_word"), "left").select(
        "row",
        F.when(F.col("count").isNotNull(), F.col("n")).otherwise(F.lit(0)).cast("long").alias("known"),
        (F.col("n") * F.log10(F.coalesce("count", F.lit(0)) + 1)).alias("more"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    together = local.withColumn("more", F.lit(0.0)).unionByName(
        seen.select(
            none("long").alias("n_tokens"),
            "row",
            none(kind).alias("id"),
            none("boolean").alias("held_out"),
            "known",
            F.lit(0.0).alias("base"),
            F.lit(0.0).alias("score"),
            "more",
        )
    )
    return (
        together.groupBy("row")
        .agg(
            F.max("id").alias(id_column),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum("known").alias("n_known"),
            (F.sum("base") + F.sum("more")).alias("base_score"),
            (F.sum("score") + F.sum("more")).alias("score"),
        )
        .withColumn("train_tokens", F.lit(words.total).cast("long"))
        .select(id_column, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    )


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents"), crc_fold("doc_id", 7) == 2)
