"""TF-IDF over one- and two-word terms.

The vocabulary comes from two aggregations, both combined before their shuffle: of words, then of the pairs of words
that are frequent enough for their pair to be kept. Weights need no shuffle at all: a ticket's counts, weights and norm
are computed inside its own row against the fitted vocabulary, whose size is a parameter.
"""

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagework.functions.numbers import half_even
from triagework.functions.text import one_and_two_grams, tokens


#: Words looked at, as a multiple of the terms to keep, for those that are as frequent as the last word kept.
TIED = 4
#: Bytes of words counted at once.
PART_BYTES = 16 << 20


@dataclass(frozen=True)
class TermSettings:
    """How many terms to keep, from how many texts on, and how to weigh them."""

    max_terms: int
    min_documents: int = 1
    sublinear: bool = True
    stop_words: tuple[str, ...] = ()


@dataclass(frozen=True)
class Vocabulary:
    """Fitted terms in alphabetical order with their inverse document frequency."""

    terms: list[str]
    idf: list[float]
    settings: TermSettings


def with_terms(df: DataFrame, text: str, stop_words: Sequence[str], name: str = "terms") -> DataFrame:
    """Add the array of a text's words and word pairs."""
    words = df.withColumn("__words", tokens(F.col(text), list(stop_words)))
    return words.withColumn(name, one_and_two_grams(F.col("__words"))).drop("__words")


def term_counts(df: DataFrame, text: str, settings: TermSettings) -> DataFrame:
    """Occurrences and number of texts per term, from one shuffle of pre-combined counts.

    Each text lists its terms twice, once with and once without repeats. The exploding is the outer kind throughout:
    for the inner kind the optimizer adds a filter on the array's size that works out every text's terms again.
    """
    terms = with_terms(df.select(text), text, settings.stop_words)
    lists = terms.select(F.posexplode_outer(F.array("terms", F.array_distinct("terms"))).alias("distinct", "list"))
    marks = lists.select("distinct", F.explode_outer("list").alias("term")).where(F.col("term").isNotNull())
    return marks.groupBy("term").agg(
        F.count_if(F.col("distinct") == 0).alias("term_count"), F.count_if(F.col("distinct") == 1).alias("doc_count")
    )


def word_counts(df: DataFrame, text: str, settings: TermSettings) -> DataFrame:
    """Occurrences and number of texts per word, counted per Arrow batch before the shuffle."""
    return _counted(df, text, settings, None, 0).withColumnRenamed("code", "term")


def pair_counts(df: DataFrame, text: str, settings: TermSettings, words: list[str], firsts: int) -> DataFrame:
    """The same per pair of neighbours among ``words``; only the first ``firsts`` of them begin a pair."""
    second = F.col("code") % len(words)
    places = [((F.col("code") - second) / len(words)).cast("int"), second.cast("int")]
    pair = F.concat_ws(" ", *[F.get(_literal(words, "string"), place) for place in places])
    return _counted(df, text, settings, words, firsts).select(pair.alias("term"), "term_count", "doc_count")


def _counted(df: DataFrame, text: str, settings: TermSettings, known: list[str] | None, firsts: int) -> DataFrame:
    """Counts per word, or, given words, per pair ``code``: the first one's place times their number, plus the second's.

    The function that runs in tasks calls none of this package, so workers need not have it.
    """
    part_bytes = PART_BYTES

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Words and the numbers of their texts, about ``part_bytes`` at once."""
        for batch in batches:
            part = np.cumsum(pc.binary_length(batch.column(0)).to_numpy()) // part_bytes
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    split = pc.split_pattern(batch.column(0).slice(a, b - a), " ")
                    yield split.flatten(), np.repeat(np.arange(b - a), pc.list_value_length(split).to_numpy())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(known or [], pa.string())
        for words, rows in parts(batches):
            if known is None:
                some = pc.not_equal(words, "")  # a text without words splits into one empty word
                coded = words.filter(some).dictionary_encode()
                codes, rows = coded.indices.to_numpy().astype(np.int64), rows[some.to_numpy(zero_copy_only=False)]
            else:
                place = pc.fill_null(pc.index_in(words, value_set=value_set), -1).to_numpy().astype(np.int64)
                pairs = (place[:-1] >= 0) & (place[:-1] < firsts) & (place[1:] >= 0) & (rows[:-1] == rows[1:])
                codes, rows = (place[:-1] * len(known) + place[1:])[pairs], rows[:-1][pairs]
            if not len(codes):
                continue
            number = int(rows[-1]) + 1
            marks, times = np.unique(codes * number + rows, return_counts=True)
            found, at, documents = np.unique(marks // number, return_index=True, return_counts=True)
            column = pa.array(found) if known else coded.dictionary.take(pa.array(found))
            counts = [pa.array(np.add.reduceat(times, at)), pa.array(documents)]
            yield pa.RecordBatch.from_arrays([column, *counts], ["code", "term_count", "doc_count"])

    joined = df.select(_joined(text, settings).alias("words"))
    kind = "string" if known is None else "long"
    found = joined.mapInArrow(run, f"code {kind}, term_count long, doc_count long")
    return found.groupBy("code").agg(F.sum("term_count").alias("term_count"), F.sum("doc_count").alias("doc_count"))


def kept_counts(df: DataFrame, text: str, settings: TermSettings) -> DataFrame:
    """Counts of terms that hold the ``max_terms`` most frequent ones.

    A pair is in no more texts, and there no more often, than its words. So a pair that is kept has no word less frequent
    than the last of the ``max_terms`` most frequent words, and its first word, which also sorts before it, is one of
    them. Where more words than usual are as frequent as that last one, all terms are counted.
    """
    order = [F.desc("term_count"), F.asc("term")]
    words = word_counts(df, text, settings).where(F.col("doc_count") >= settings.min_documents)
    found = words.orderBy(*order).limit(TIED * settings.max_terms).collect()
    top = found[: settings.max_terms]
    least = top[-1]["term_count"] if len(top) == settings.max_terms else 0
    if not top or (len(found) == TIED * settings.max_terms and found[-1]["term_count"] >= least):
        return term_counts(df, text, settings)
    frequent = [row["term"] for row in found if row["term_count"] >= least]
    pairs = pair_counts(df, text, settings, frequent, len(top)).where(F.col("term_count") >= least)
    return df.sparkSession.createDataFrame(top, pairs.schema).unionByName(pairs)


def top_terms(df: DataFrame, text: str, settings: TermSettings) -> DataFrame:
    """The most frequent terms, numbered alphabetically from 0; equal counts go by the term."""
    kept = (
        kept_counts(df, text, settings)
        .where(F.col("doc_count") >= settings.min_documents)
        .orderBy(F.desc("term_count"), "term")
        .limit(settings.max_terms)
    )
    return kept.select(
        "term", "term_count", "doc_count", (F.row_number().over(Window.orderBy("term")) - 1).cast("long").alias("term_index")
    )


def fit_vocabulary(train: DataFrame, text: str, settings: TermSettings) -> Vocabulary:
    """Fit on ``train``. At most ``max_terms`` terms reach the driver, as part of the model."""
    documents = train.count()
    idf = F.ln(F.lit(1.0 + documents) / (F.col("doc_count") + 1.0)) + 1.0
    rows = top_terms(train, text, settings).select("term", idf.alias("idf")).orderBy("term").collect()
    return Vocabulary([r.term for r in rows], [r.idf for r in rows], settings)


def with_weights(df: DataFrame, text: str, vocabulary: Vocabulary) -> DataFrame:
    """Add ``indices`` and unit-length ``weights`` of the text's known terms."""
    return _weighed(df.withColumn("__words", _joined(text, vocabulary.settings)), vocabulary)


def _joined(text: str, settings: TermSettings) -> Column:
    """The words of a text as one text, which is sent to Python far faster than a list."""
    return F.array_join(tokens(F.col(text), list(settings.stop_words)), " ")


def _with_counts(df: DataFrame, terms: list[str]) -> DataFrame:
    """``df`` without its last column, ``__words``, plus ``indices`` of the terms there and their ``__counts``."""
    split = [term.split(" ") for term in terms]
    words = list(dict.fromkeys(word for term in split for word in term))
    number = {word: i for i, word in enumerate(words)}
    places = {tuple(number[w] for w in term): i for i, term in enumerate(split)}
    pairs = sorted((key[0] * len(words) + key[1], i) for key, i in places.items() if len(key) == 2)
    of_word = np.array([places.get((i,), -1) for i in range(len(words))], np.int64)
    of_pair = np.array(pairs, np.int64).reshape(-1, 2)
    part_bytes, names = PART_BYTES, [*df.columns[:-1], "indices", "__counts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set, width, size = pa.array(words, pa.string()), len(words), max(len(of_word), len(terms), 1)
        for batch in batches:
            part = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy()) // part_bytes
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                split = pc.split_pattern(batch.column(batch.num_columns - 1).slice(a, b - a), " ")
                rows = np.repeat(np.arange(b - a), pc.list_value_length(split).to_numpy())
                place = pc.fill_null(pc.index_in(split.flatten(), value_set=value_set), -1).to_numpy().astype(np.int64)
                known = np.flatnonzero(place >= 0)
                single = of_word[place[known]]
                marks = [(rows[known] * size + single)[single >= 0]]
                both = np.flatnonzero((place[:-1] >= 0) & (place[1:] >= 0) & (rows[:-1] == rows[1:]))
                if len(of_pair):
                    code = place[both] * width + place[both + 1]
                    at = np.minimum(np.searchsorted(of_pair[:, 0], code), len(of_pair) - 1)
                    hit = of_pair[at, 0] == code
                    marks.append(rows[both[hit]] * size + of_pair[at[hit], 1])
                found, times = np.unique(np.concatenate(marks), return_counts=True)
                ends = pa.array(np.searchsorted(found, np.arange(b - a + 1) * size), pa.int32())
                lists = [
                    pa.ListArray.from_arrays(ends, pa.array(found % size, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(times.astype(np.float64))),
                ]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], *lists], names)

    added = [T.StructField(names[-2], T.ArrayType(T.IntegerType())), T.StructField(names[-1], T.ArrayType(T.DoubleType()))]
    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], *added]))


def _weighed(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    counted = _with_counts(df, vocabulary.terms)
    idf = _literal([repr(x) for x in vocabulary.idf], "double")

    def weight(count: Column, index: Column) -> Column:
        frequency = F.ln(count) + 1.0 if vocabulary.settings.sublinear else count
        return frequency * F.get(idf, index)

    weighed = counted.withColumn("__raw", F.zip_with("__counts", "indices", weight))
    norm = F.sqrt(F.aggregate("__raw", F.lit(0.0), lambda total, w: total + w * w))
    # The norm is bound as a lambda argument: as a plain column it would be worked out again for every element.
    unit = F.transform(F.array(norm), lambda n: F.transform("__raw", lambda w: w / n))[0]
    return weighed.withColumn("weights", unit).drop("__counts", "__raw")


def _literal(values: list[str], element: str) -> Column:
    """Array literal sent as one text; the optimizer turns it into a constant. No term holds a line break."""
    return F.split(F.lit("\n".join(values)), "\n").cast(f"array<{element}>")


def tfidf_long(df: DataFrame, text: str, vocabulary: Vocabulary, keep: list[str], digits: int = 6) -> DataFrame:
    """One row per text and known term: the columns ``keep``, ``term`` and ``weight``."""
    if not vocabulary.terms:
        return df.limit(0).select(*keep, F.lit("").alias("term"), F.lit(0.0).alias("weight"))
    weighed = _weighed(df.select(*keep, _joined(text, vocabulary.settings).alias("__words")), vocabulary)
    entries = weighed.select(*keep, F.inline_outer(F.arrays_zip("indices", "weights"))).where("indices is not null")
    return entries.select(
        *keep,
        F.get(_literal(vocabulary.terms, "string"), F.col("indices")).alias("term"),
        half_even(F.col("weights"), digits).alias("weight"),
    )
