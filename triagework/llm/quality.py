"""Quality selection by importance resampling.

Texts are bags of hashed n-grams. Two generative models, one of texts labelled as target and one of all raw texts, give
every bucket the logarithm of the ratio of its probabilities; a text's weight is the sum over its n-grams. Gumbel noise
is added to the weights and the documents with the k largest sums are the sample.

Besides words and pairs of words, the n-grams hold the shape of words (capitals, digits, signs ...), pairs of shapes,
and whether a word repeats the one before: what tells junk from prose even where words are never seen twice.

A sum over a whole text hides a few words that only texts labelled as no target hold. So words have a second ratio, of the
shares of target and of other labelled texts they occur in, by their exact hash. A text whose ``WORST`` lowest ratios sum
up to less than what the share ``keep_target`` of target texts left out of the fit reaches loses, per n-gram, more than
the ratios of two n-grams can differ by, and so comes after all others of its length.

Both target models are fitted on a bounded sample of labelled rows (``LABEL_ROWS``); the raw model counts every document.
Without a given ``k`` it is the number of documents whose weight comes up to that which the share ``keep_target`` of target
texts reaches that were labelled but left out of the fit; noise then decides between documents near the border. Null and
empty texts have weight 0. Repeated rows have equal weights and noise and stay or go together; rows that share the k-th key
all stay. Without target labels no text has a weight other than 0, and all stay. No rows give no rows. Other columns are not
read. Long texts are worked on in pieces cut at white space.
"""

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.llm.common import CHUNK_CHARS, in_chunks, read_table, releasing, scratch, small_batches

BUCKETS = 1 << 17
LABEL_ROWS = 65_536
#: One labelled row in so many sets the cut instead of being learned from.
CUT_FOLDS = 4
#: Pseudo-counts that pull the ratio of rare n-grams to 1.
PRIOR = 20.0
KEEP_TARGET = 0.998
#: A word is listed with a ratio of at most ``LISTED`` if so many texts that are no target hold it.
LEAST_TEXTS = 3
LISTED = -0.5
#: Texts added to both counts of a word.
WORD_PRIOR = 2.0
WORST = 3
#: Fraction bits of a key that is compared as a whole number.
KEY_BITS = 24
REMEMBERED = 100_000
WORDS_AT_ONCE = 200_000
SPACE = re.compile(r"\s")
WORD = re.compile(r"\w+|[^\w\s]+")
SHAPES = 8


def shape_of(word: str) -> int:
    """0 signs, 1 digits, 2 lower case, 3 capitals, 4 one capital letter, 5 first letter capital, 6 other mixtures."""
    if not (word[0].isalnum() or word[0] == "_"):
        return 0
    if word.isdigit():
        return 1
    if word.islower():
        return 2
    if word.isupper():
        return 3 if len(word) > 1 else 4
    return 5 if word[0].isupper() and word[1:].islower() else 6


class Hashed(dict):
    """Hash and shape of words seen before, in one number; it ends with the partition that made it."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode("utf-8", "surrogatepass")) * SHAPES + shape_of(word)
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


def mixed(values: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of 64-bit values."""
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return ((values >> np.uint64(29)) % np.uint64(buckets)).astype(np.int64)


def pieces(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """A text cut at white space into pieces of about ``size`` characters; no word is cut."""
    at = 0
    while len(text) - at > size:
        found = SPACE.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def coded_words(text: str | None, hashed: Hashed) -> np.ndarray:
    """Hash and shape of every word of a text."""
    parts = []
    for piece in pieces(text or ""):
        words = WORD.findall(piece)
        parts.append(np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(parts)


def gram_parts(coded: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text with these words, a bounded number at a time."""
    for at in range(0, len(coded), WORDS_AT_ONCE):
        yield gram_buckets(coded[at : at + WORDS_AT_ONCE], buckets, coded[max(0, at - 1) : at])


def features(text: str | None, buckets: int, hashed: Hashed | None = None) -> np.ndarray:
    """Buckets of a text's n-grams."""
    parts = list(gram_parts(coded_words(text, Hashed() if hashed is None else hashed), buckets))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def gram_buckets(coded: np.ndarray, buckets: int, before: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams that end in these words; ``before`` holds the word before them, if there is one."""
    shape = coded % np.uint64(SHAPES)
    earlier = np.concatenate([before, coded])[: len(coded) + len(before) - 1]
    own, own_shape = coded[len(coded) - len(earlier) :], shape[len(coded) - len(earlier) :]
    again = own == earlier
    pairs = earlier * np.uint64(1_000_003) + own + np.uint64(1 << 50)
    shapes = (earlier % np.uint64(SHAPES)) * np.uint64(16) + own_shape
    if len(earlier) < len(coded):
        shapes = np.concatenate([np.uint64(SHAPES * 16) + shape[:1], shapes])
    repeats = np.concatenate([np.zeros(len(coded) - len(earlier), bool), again])
    shapes = np.uint64(1 << 40) + shapes * np.uint64(2) + repeats
    return mixed(np.concatenate([coded, pairs[~again], shapes]), buckets)


def labelled_sample(labels: DataFrame, target: Column, id_column: str = "doc_id", rows: int = LABEL_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids, those with the smallest hashes; whether they are ``target``, and set the cut."""
    known = labels.select(F.col(id_column).alias("__labelled"), F.coalesce(target, F.lit(False)).alias("__target"))
    known = known.where("__labelled is not null").groupBy("__labelled").agg(F.min("__target").alias("__target"))
    cut = F.pmod(F.xxhash64("__labelled", F.lit(6)), F.lit(CUT_FOLDS)) == 0
    return known.orderBy(F.xxhash64("__labelled", F.lit(5)), "__labelled").limit(rows).withColumn("__cut", cut)


def log_ratios(
    docs: DataFrame, sample: DataFrame, buckets: int = BUCKETS, id_column: str = "doc_id", text_column: str = "text"
) -> np.ndarray | None:
    """Per bucket the log of target over raw probability; None without target texts.

    ``sample`` has at most ``LABEL_ROWS`` rows and is broadcast; one number pair per bucket reaches the driver.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, hashed = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), Hashed()
        for rows, texts in in_chunks(batches, 0):
            held: dict[bool, list[np.ndarray]] = {False: [], True: []}
            for text, chosen in zip(texts, rows.column(1).to_pylist(), strict=True):
                for part in gram_parts(coded_words(text, hashed), buckets):
                    held[chosen].append(part)
                    if len(part) > WORDS_AT_ONCE:
                        raw += (counts := np.bincount(held[chosen].pop(), minlength=buckets))
                        target += counts * chosen
            for chosen, parts in held.items():
                if parts:
                    raw += (counts := np.bincount(np.concatenate(parts), minlength=buckets))
                    target += counts * chosen
        some = np.flatnonzero(raw)
        for at in range(0, len(some), 50_000):
            part = some[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(raw[part]), pa.array(target[part])], ["bucket", "raw", "target"]
            )

    learned = F.broadcast(sample.where("__target and not __cut"))
    marked = docs.join(learned, F.col(id_column) == F.col("__labelled"), "left").select(
        F.col(text_column).cast("string").alias("text"), F.coalesce("__target", F.lit(False)).alias("target")
    )
    found = (
        marked.mapInArrow(releasing(count), "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toArrow()
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[found["bucket"].to_numpy()], target[found["bucket"].to_numpy()] = found["raw"], found["target"]
    if not target.sum():
        return None
    return np.log((target * (raw.sum() / target.sum()) + PRIOR) / (raw + PRIOR))


@dataclass
class BadWords:
    """Words that texts labelled as no target hold more often, in the order of their codes, and the least score."""

    codes: np.ndarray
    ratios: np.ndarray
    cut: float = float("-inf")

    def score(self, coded: np.ndarray) -> float:
        """Sum of the lowest ratios among a text's distinct words."""
        if not len(self.codes):
            return 0.0
        at = np.minimum(np.searchsorted(self.codes, coded), len(self.codes) - 1)
        found = np.sort(self.ratios[np.unique(at[self.codes[at] == coded])])
        return float(found[:WORST].sum())


def bad_words(docs: DataFrame, sample: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> BadWords:
    """Ratios of listed words, from the texts of ``sample`` that do not set the cut.

    Counts are combined by word before anything reaches the driver, which gets the listed words alone.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for rows, texts in in_chunks(batches, 0):
            target = np.array(rows.column(1).to_pylist(), bool)
            # Code -1 counts texts.
            words = [np.append(np.unique(coded_words(t, hashed)).astype(np.int64), -1) for t in texts]
            code, place = np.unique(np.concatenate(words), return_inverse=True)
            is_target = np.repeat(target, [len(w) for w in words])
            both = np.bincount(place, minlength=len(code))
            good = np.bincount(place[is_target], minlength=len(code))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(good), pa.array(both - good)], ["code", "good", "bad"])

    learned = F.broadcast(sample.where("not __cut"))
    marked = docs.join(learned, F.col(id_column) == F.col("__labelled")).select(
        F.col(text_column).cast("string").alias("text"), F.col("__target").alias("target")
    )
    counts = scratch(
        marked.mapInArrow(releasing(count), "code long, good long, bad long")
        .groupBy("code")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")),
        "label_words",
    )
    texts = counts.where("code = -1").first()
    if texts is None or not texts["good"] or not texts["bad"]:
        return BadWords(np.zeros(0, np.uint64), np.zeros(0))
    ratio = F.log(
        (F.col("good") * F.lit(texts["bad"] / texts["good"]) + F.lit(WORD_PRIOR)) / (F.col("bad") + F.lit(WORD_PRIOR))
    )
    listed = counts.where((F.col("code") >= 0) & (F.col("bad") >= LEAST_TEXTS) & (ratio <= LISTED))
    found = listed.select("code", ratio.alias("ratio")).orderBy("code").toArrow()
    return BadWords(found["code"].to_numpy().astype(np.uint64), found["ratio"].to_numpy())


def gumbel(id_column: str, seed: int = 11) -> Column:
    """Gumbel noise that depends on the id alone, so that a retried task repeats it."""
    uniform = (F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def weighed(
    docs: DataFrame,
    ratios: np.ndarray | None,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_text: bool = True,
    bad: BadWords | None = None,
) -> DataFrame:
    """The columns of ``docs`` plus ``log_weight`` and ``sampling_key``, the weight with noise."""
    at = docs.columns.index(text_column)
    carried = [i for i in range(len(docs.columns)) if with_text or i != at]
    names = [*[docs.columns[i] for i in carried], "log_weight"]

    # A text that falls below the cut of bad words loses more than the sums of its n-grams can differ by.
    span = 0.0 if ratios is None else 2 * float(np.abs(ratios).max()) + 1

    def weight(text: str | None, hashed: Hashed) -> float:
        if ratios is None:
            return 0.0
        coded = coded_words(text, hashed)
        value, grams = 0.0, 0
        for part in gram_parts(coded, len(ratios)):
            value += float(ratios[part].sum())
            grams += len(part)
        return value - span * grams if bad is not None and bad.score(coded) < bad.cut else value

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for rows, texts in in_chunks(batches, at):
            weights = [weight(t, hashed) for t in texts]
            columns = [*[rows.column(i) for i in carried], pa.array(weights, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = docs.select(*names[:-1], F.lit(0.0).alias("log_weight")).schema
    return docs.mapInArrow(releasing(weigh), schema).withColumn("sampling_key", F.col("log_weight") + gumbel(id_column))


def packed_key() -> Column:
    """The sampling key as a whole number, in the same order; keys beyond its range share its ends."""
    scaled = F.floor(F.col("sampling_key") * F.lit(2.0**KEY_BITS))
    return F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62 - 2.0**10), scaled.cast("double"))).cast("long")


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest packed key of a stored table, digit by digit: 4,096 counts at a time reach the driver.

    None if there are fewer than ``k`` rows; above all keys if ``k`` is 0.
    """
    if k <= 0:
        return (1 << 63) - 1
    packed = keys.select(packed_key().alias("v"))
    low, width = -(1 << 62), 63
    while width > 0:
        step = max(0, width - 12)
        inside = packed.where((F.col("v") >= low) & (F.col("v") < low + (1 << width)))
        counts = inside.groupBy(F.shiftright(F.col("v") - F.lit(low), step).alias("d")).count().collect()
        digit = None
        for d, n in sorted(counts, reverse=True):
            if k <= n:
                digit = d
                break
            k -= n
        if digit is None:
            return None
        low, width = low + (digit << step), step
    return low


def cuts(
    docs: DataFrame,
    sample: DataFrame,
    ratios: np.ndarray | None,
    bad: BadWords,
    keep_target: float = KEEP_TARGET,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[float, float]:
    """The key, and the score of bad words, that the share ``keep_target`` of the labelled target texts reaches."""
    if ratios is None:
        return float("-inf"), float("-inf")
    target = docs.select(id_column, text_column).join(
        F.broadcast(sample.where("__target and __cut")), F.col(id_column) == F.col("__labelled"), "left_semi"
    )

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for rows, texts in in_chunks(batches, 2):
            scores = pa.array([bad.score(coded_words(t, hashed)) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), scores], ["id", "key", "score"])

    keys = weighed(target, ratios, id_column, text_column).select(id_column, "log_weight", text_column)
    kind = docs.schema[id_column].dataType.simpleString()
    found = keys.mapInArrow(releasing(score), f"id {kind}, key double, score double")
    share = F.lit(1 - keep_target)
    least = found.agg(F.percentile("key", share), F.percentile("score", share)).first()
    return tuple(float("-inf") if v is None else v for v in least)


def fitted(
    docs: DataFrame, labels: DataFrame, target: Column, keep_target: float = KEEP_TARGET, id_column: str = "doc_id"
) -> tuple[np.ndarray | None, BadWords, float]:
    """Log ratios, bad words, and the weight that counts how many documents are to be drawn."""
    sample = scratch(labelled_sample(labels, target, id_column), "labels")
    ratios = log_ratios(docs, sample, id_column=id_column)
    bad = bad_words(docs, sample, id_column)
    cut, bad.cut = cuts(docs, sample, ratios, bad, keep_target, id_column)
    return ratios, bad, cut


def drawn(weights: DataFrame, cut: float, k: int | None = None) -> Column:
    """Whether a row of the stored table ``weights`` is among the ``k`` with the largest keys (Gumbel top-k).

    Without ``k`` it is the number of rows whose weight reaches ``cut``. Rows that share the k-th key are all drawn.
    """
    count = weights.where(F.col("log_weight") >= F.lit(cut)).count() if k is None else k
    least = kth_largest(weights, count)
    return F.lit(True) if least is None else packed_key() >= F.lit(least)


def resampled(docs: DataFrame, labels: DataFrame, target: Column, k: int | None = None, id_column: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: id, ``log_weight``, ``sampling_key`` and whether it is in the sample (``kept``)."""
    small_batches(docs.sparkSession)
    ratios, bad, cut = fitted(docs, labels, target, id_column=id_column)
    out = scratch(weighed(docs.select(id_column, "text"), ratios, id_column, with_text=False, bad=bad), "weights")
    return out.withColumn("kept", drawn(out, cut, k))


def keep_good(docs: DataFrame, labels: DataFrame, target: Column, k: int | None = None, id_column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` in the sample, all columns as they were; texts are stored with their keys, not shuffled."""
    small_batches(docs.sparkSession)
    ratios, bad, cut = fitted(docs.select(id_column, "text"), labels, target, id_column=id_column)
    inner = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    key, text = (f"c{docs.columns.index(c)}" for c in (id_column, "text"))
    stored = scratch(weighed(inner, ratios, key, text, bad=bad), "weighed")
    kept = stored.where(drawn(stored, cut, k))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def is_target() -> Column:
    """Labelled as good and not as toxic."""
    return (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), is_target())
