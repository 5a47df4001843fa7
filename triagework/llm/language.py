"""Language identification by error-correcting output codes.

Every learned language has a codeword of bits. One binary classifier per bit says, from hashed character n-grams of the
whole text, on which side of the bit the text's language is: the mean over its n-grams of the log ratio between the
languages with a one and those with a zero. Decoding adds up, bit by bit, the loss of a codeword's bit given the
classifier's margin, weighted by how reliable the bit was in training, and takes the codeword with the least loss.

``score`` is the soft minimum over codewords. A text is ambiguous if its second-best codeword comes close: if its lead, the
difference of the two losses, is below what all but the share ``LOW`` of the language's training texts reach under models
that left out the texts' folds. Equal texts share a fold. Every training text counts, in a histogram per language. Null texts and
texts without a letter are ``und`` with score 0; so is every text if nothing could be learned. Repeated rows get equal
results, no rows give no rows, other columns are not read.
"""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.llm.common import CHUNK_CHARS, crc_fold, in_chunks, read_table, releasing, small_batches

BUCKETS = 1 << 14
UNKNOWN = "und"
GRAMS_AT_ONCE = 1 << 16
#: Codes of so few languages hold every way to split them; larger ones are drawn.
ALL_SPLITS = 6
SHARPNESS = 8.0
#: Least share of the two best codewords' scores that the best must have, whatever the training texts reach.
CLEAR = 0.55
#: Share of a language's training texts that may lie below its limit.
LOW = 0.005
FOLDS = 4
#: Steps of the histogram of leads: so many of a unit, and in all.
STEPS, ALL_STEPS = 64, 1 << 13


def has_letter(text: str) -> bool:
    """Whether a text holds a letter of any script; signs such as fractions or circled digits are none."""
    return any(map(str.isalpha, text))


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all runs of three bytes of the lowered text, with a space at both ends, a bounded number at a time."""
    before = b" "
    for at in range(0, len(text), CHUNK_CHARS):
        data = before + text[at : at + CHUNK_CHARS].lower().encode("utf-8", "surrogatepass")
        before = data[-2:]
        yield buckets_of(data + b" " if at + CHUNK_CHARS >= len(text) else data)


def buckets_of(data: bytes) -> np.ndarray:
    numbers = np.frombuffer(data, np.uint8).astype(np.uint32)
    whole = (numbers[:-2] << np.uint32(16)) | (numbers[1:-1] << np.uint32(8)) | numbers[2:]
    return ((whole * np.uint32(2654435761)) >> np.uint32(32 - (BUCKETS - 1).bit_length())).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 per language: all splits of few languages, else the best of drawn codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= ALL_SPLITS:
        columns = np.arange(1, 1 << (n - 1))
        return np.where((columns[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    rng, bits = np.random.default_rng(n), int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code[0, np.abs(code.sum(axis=0)) == n] *= -1
        distances = (bits - code @ code.T) / 2
        least = distances[~np.eye(n, dtype=bool)].min()
        if least > apart:
            best, apart = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # per bit
    limits: np.ndarray | None = None  # per language, the least lead of a clear text

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Per text and language: the weighted logistic loss of the codeword."""
        return np.logaddexp(0, -SHARPNESS * margins[:, None, :] * self.code[None]) @ self.trust

    def decoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each text holds a letter and can be judged, and its losses and lead."""
        known = np.array([bool(self.languages) and bool(t) and has_letter(t) for t in texts], bool)
        margins = np.zeros((len(texts), self.weights.shape[1]))
        for i in np.flatnonzero(known):
            number = 0
            for part in grams(texts[i]):
                for at in range(0, len(part), GRAMS_AT_ONCE):
                    margins[i] += self.weights[part[at : at + GRAMS_AT_ONCE]].sum(axis=0, dtype=np.float64)
                number += len(part)
            margins[i] /= number
        losses = self.losses(margins)
        if len(self.languages) < 2:
            return known, losses, np.full(len(texts), np.inf)
        least = np.partition(losses, 1, axis=1)
        return known, losses, least[:, 1] - least[:, 0]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        known, losses, lead = self.decoded(texts)
        best = losses.argmin(axis=1)
        near = np.exp(losses.min(axis=1, keepdims=True) - losses)
        score = np.where(known, 1 / near.sum(axis=1), 0.0)
        limits = np.zeros(len(self.languages)) if self.limits is None else self.limits
        unclear = ~known | (lead < np.maximum(limits, np.log(CLEAR / (1 - CLEAR)))[best])
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score, unclear


def in_folds(docs: DataFrame, folds: int, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``text``, ``lang`` and ``fold`` of all texts with a language."""
    text = F.col(text_column).cast("string")
    fold = F.pmod(F.xxhash64(text), F.lit(folds)).cast("int")
    known = docs.where(F.col(lang_column).isNotNull())
    return known.select(text.alias("text"), F.col(lang_column).cast("string").alias("lang"), fold.alias("fold"))


def gram_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", folds: int = 1) -> DataFrame:
    """``lang``, ``fold``, ``bucket``, ``n`` over all texts with a language and a letter; counted per task before the shuffle."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], np.ndarray] = {}
        for rows, texts in in_chunks(batches, 0):
            here: dict[tuple[str, int], np.ndarray] = {}
            keys = zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)
            for text, key in zip(texts, keys, strict=True):
                if text and has_letter(text):
                    for part in grams(text):
                        counts = here.setdefault(key, np.zeros(BUCKETS, np.int64))
                        counts += np.bincount(part, minlength=BUCKETS)
            for key, counts in here.items():
                found[key] = found[key] + counts if key in found else counts
        for (lang, fold), counts in found.items():
            some = np.flatnonzero(counts)
            columns = [[lang] * len(some), pa.array([fold] * len(some), pa.int32()), some, counts[some]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["lang", "fold", "bucket", "n"])

    known = in_folds(docs, folds, text_column, lang_column)
    counted = known.mapInArrow(releasing(count), "lang string, fold int, bucket long, n long")
    return counted.groupBy("lang", "fold", "bucket").agg(F.sum("n").alias("n"))


def model_of(languages: list[str], counts: np.ndarray) -> Model:
    """Model of the counts per language and bucket."""
    code = codewords(len(languages))
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS) if languages else counts
    ones, zeros = (code > 0).astype(float), (code < 0).astype(float)
    side = lambda member: (member.T @ share) / np.maximum(1, member.sum(axis=0))[:, None]
    weights = (np.log(side(ones)) - np.log(side(zeros))).T if code.shape[1] else np.zeros((BUCKETS, 0))
    # How far apart a bit's two sides are on the training texts: the smallest mean margin among the languages.
    margins = share @ weights
    apart = np.maximum((margins * code).min(axis=0, initial=np.inf) if languages else np.zeros(0), 1e-3)
    trust = apart / apart.sum() if code.shape[1] else apart[:0]
    return Model(languages, code, weights.astype(np.float32), trust)


def lead_limits(docs: DataFrame, languages: list[str], models: list[Model]) -> np.ndarray:
    """Per language the lead that all but the share ``LOW`` of its texts reach; ``models[i]`` left out fold ``i``.

    Texts that get another language than their own do not count, a language without any other text has no limit. One
    number per language and step reaches the driver.
    """
    place = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(languages), ALL_STEPS), np.int64)
        for rows, texts in in_chunks(batches, 0):
            own = np.array([place.get(x, -1) for x in rows.column(1).to_pylist()])
            fold = rows.column(2).to_numpy()
            for f in np.unique(fold).tolist():
                mine = np.flatnonzero(fold == f)
                known, losses, lead = models[f].decoded([texts[i] for i in mine])
                right = known & (losses.argmin(axis=1) == own[mine])
                step = np.minimum(lead[right] * STEPS, ALL_STEPS - 1).astype(np.int64)
                np.add.at(table, (own[mine][right], step), 1)
        lang, step = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(step), pa.array(table[lang, step])], ["lang", "step", "n"])

    counted = docs.mapInArrow(releasing(count), "lang long, step long, n long").groupBy("lang", "step").agg(F.sum("n").alias("n"))
    table = np.zeros((len(languages), ALL_STEPS), np.int64)
    for lang, step, n in counted.collect():
        table[lang, step] = n
    below = np.cumsum(table, axis=1) <= LOW * table.sum(axis=1, keepdims=True)
    return np.where(table.any(axis=1), below.sum(axis=1), 0) / STEPS


def fit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> Model:
    """Model of ``docs``; one number per language, fold and bucket reaches the driver."""
    table = gram_counts(docs, text_column, lang_column, FOLDS).toArrow()
    langs = np.array(table["lang"].to_pylist(), object)
    languages = sorted(set(langs.tolist()))
    counts = np.zeros((FOLDS, len(languages), BUCKETS))
    for i, lang in enumerate(languages):
        mine = np.flatnonzero(langs == lang)
        counts[table["fold"].to_numpy()[mine], i, table["bucket"].to_numpy()[mine]] = table["n"].to_numpy()[mine]
    total = counts.sum(axis=0)
    model = model_of(languages, total)
    if len(languages) > 1:
        without = [model_of(languages, total - part) for part in counts]
        model.limits = lead_limits(in_folds(docs, FOLDS, text_column, lang_column), languages, without)
    return model


def predicted(docs: DataFrame, model: Model, text_column: str = "text", with_text: bool = True) -> DataFrame:
    """The columns of ``docs`` plus ``lang_pred``, ``score`` and ``ambiguous``."""
    at = docs.columns.index(text_column)
    carried = [i for i in range(len(docs.columns)) if with_text or i != at]
    names = [*[docs.columns[i] for i in carried], "lang_pred", "score", "ambiguous"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in in_chunks(batches, at):
            lang, score, unclear = model.predict(texts)
            columns = [rows.column(i) for i in carried]
            columns += [pa.array(lang, pa.string()), pa.array(score), pa.array(unclear)]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = [F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous")]
    return docs.mapInArrow(releasing(run), docs.select(*names[:-3], *more).schema)


def keep_known(docs: DataFrame, train: Column, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Rows of ``docs`` whose language is clear, all columns as they were; ``train`` tells which rows are learned from."""
    small_batches(docs.sparkSession)
    model = fit(docs.where(train).select(text_column, lang_column), text_column, lang_column)
    inner = docs.select(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kept = predicted(inner, model, f"c{docs.columns.index(text_column)}").where(~F.col("ambiguous"))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 3) == 1
    model = fit(docs.where(~held_out).select("text", "lang"))
    rows = docs.select("doc_id", F.col("text"), held_out.alias("held_out"))
    return predicted(rows, model, with_text=False)
