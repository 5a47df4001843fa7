import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagework.llm.class_lm import (
    Settings,
    class_bigrams,
    ending_column,
    ending_of,
    exchanged,
    likelihood,
    op2_class_lm,
    scored,
)
from triagework.llm.common import crc_fold, lowered


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def plain_base(rows):
    counts, total = {}, 0
    for doc_id, text in rows:
        if not held(doc_id):
            tokens = [*lowered(text).split(), "end"]
            total += len(tokens)
            for t in tokens:
                counts[t] = counts.get(t, 0) + 1
    out = []
    for _, text in rows:
        tokens = [*lowered(text).split(), "end"]
        base = sum(math.log10((counts.get(t, 0) + 1) / (total + len(counts) + 1)) for t in tokens)
        out.append((len(tokens), sum(t in counts for t in tokens), total, base))
    return out


SMALL = Settings(listed=40, own_units=20, endings=16, classes=6, sweeps=3)


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    kinds = [[f"{p}{i}" for i in range(60)] for p in ("al", "be", "ga")]
    chance = 1 / np.arange(1, 61)
    return [" ".join(rng.choice(kinds[i % 3], 40, p=chance / chance.sum())) for i in range(n)]


def test_scores(spark):
    rows = [(i, t) for i, t in enumerate(texts(120))]
    rows += [(900, None), (901, ""), (902, "Al0 \x0bNEVER seen"), (None, "al1"), (903, "w " * 30_000), (904, "é AL0"), (904, "é AL0")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    got = scored(docs, crc_fold("doc_id", 7) == 2, SMALL).collect()
    expected = plain_base(rows)
    by_base = sorted((str(i), held(i), n, k, t, round(b, 6)) for (i, _), (n, k, t, b) in zip(rows, expected, strict=True))
    assert sorted(
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got
    ) == by_base
    unseen = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 120]
    assert len(unseen) > 5 and sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert all(r.score < 0 for r in got)


def test_exchange_raises_the_likelihood_and_finds_classes():
    rng = np.random.default_rng(1)
    units, c = 40, SMALL.classes
    language = np.array([0] + [1 + i % 2 for i in range(units - 1)])
    text = [0]
    for _ in range(3000):
        text += [0, *rng.choice(np.flatnonzero(language == rng.integers(1, 3)), 6).tolist()]
    text = np.array(text)
    classes = np.concatenate([[0], 1 + np.arange(units - 1) % 5])
    values = []
    for _ in range(5):
        right, left = np.zeros((units, c), np.int64), np.zeros((units, c), np.int64)
        np.add.at(right, (text[:-1], classes[text[1:]]), 1)
        np.add.at(left, (text[1:], classes[text[:-1]]), 1)
        own = np.bincount(text[:-1][text[:-1] == text[1:]], minlength=units)
        values.append(likelihood(class_bigrams(right, classes)))
        classes = exchanged(right, left, own, classes, np.arange(1, units))
    assert values[-1] > values[0]
    assert not set(classes[language == 1]) & set(classes[language == 2])


def test_one_exchange_equals_trying_every_class():
    rng = np.random.default_rng(2)
    units, c = 12, SMALL.classes
    text = np.concatenate([[0], rng.integers(0, units, 400)])
    classes = np.concatenate([[0], 1 + rng.integers(0, 4, units - 1)])

    def table(k):
        n = np.zeros((c, c))
        np.add.at(n, (k[text[:-1]], k[text[1:]]), 1)
        return likelihood(n)

    for u in range(1, units):
        right, left = np.zeros((units, c), np.int64), np.zeros((units, c), np.int64)
        np.add.at(right, (text[:-1], classes[text[1:]]), 1)
        np.add.at(left, (text[1:], classes[text[:-1]]), 1)
        own = np.bincount(text[:-1][text[:-1] == text[1:]], minlength=units)
        moved = exchanged(right, left, own, classes, np.array([u]))
        tried = [table(np.where(np.arange(units) == u, b, classes)) for b in range(1, c)]
        assert table(moved) == pytest.approx(max(tried))


def test_endings_agree(spark):
    words = [b"", b"a", b"ab", b"abc", b"abcd", "é".encode(), b"x" * 1000]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w binary").select(ending_column(F.col("w"), 77)).collect()]
    assert got == [ending_of(w, 77) for w in words]


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in scored(docs, F.lit(True), SMALL).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == 0 and got[2].n_tokens == 1
    assert scored(docs.limit(0), F.lit(False), SMALL).count() == 0


def test_model_beats_the_base_on_held_out_documents(spark, small):
    got = op2_class_lm(spark, small).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
