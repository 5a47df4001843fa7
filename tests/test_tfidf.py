import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from triagework.models.features import tfidf_stages
from triagework.operators import tfidf

TEXTS = [
    "payment failed payment failed again",
    "cannot log in the payment page",
    "the the the app crashed",
    "",
    "a b c",
    "app crashed again when paying the bill again again",
    None,
]


def grams(value, stop):
    words = [w for w in re.findall(r"(?u)\b\w\w+\b", (value or "").lower()) if w not in stop]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_force(texts, max_terms, min_documents, sublinear, stop):
    """Terms, then one dense unit vector per text."""
    rows = [Counter(grams(t, stop)) for t in texts]
    total, documents = Counter(), Counter()
    for row in rows:
        total.update(row)
        documents.update(row.keys())
    kept = sorted(t for t in total if documents[t] >= min_documents)
    kept = sorted(sorted(kept, key=lambda t: (-total[t], t))[:max_terms])
    idf = {t: math.log((1 + len(texts)) / (1 + documents[t])) + 1 for t in kept}
    vectors = []
    for row in rows:
        raw = np.array([((1 + math.log(row[t])) if sublinear else row[t]) * idf[t] if row[t] else 0.0 for t in kept])
        norm = np.linalg.norm(raw)
        vectors.append(raw / norm if norm else raw)
    return kept, vectors


@pytest.mark.parametrize(
    ("max_terms", "min_documents", "sublinear", "stop"),
    [(1000, 1, True, ()), (6, 2, True, ()), (8, 1, False, ("the", "in")), (3, 2, False, ())],
)
def test_weights_equal_brute_force(spark, max_terms, min_documents, sublinear, stop):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").repartition(3)
    settings = tfidf.TermSettings(max_terms, min_documents, sublinear, stop)
    vocabulary = tfidf.fit_vocabulary(df, "t", settings)
    kept, vectors = brute_force(TEXTS, max_terms, min_documents, sublinear, stop)
    assert vocabulary.terms == kept

    entries = tfidf.tfidf_long(df, "t", vocabulary, ["k"], digits=9).collect()
    got = {(r.k, r.term): r.weight for r in entries}
    expected = {(k, t): v for k, row in enumerate(vectors) for t, v in zip(kept, row) if v}
    assert got == pytest.approx(expected, abs=1e-8)

    scored = PipelineModel(tfidf_stages("t", vocabulary)).transform(df).select("k", "t_tfidf").collect()
    for row in scored:
        assert row.t_tfidf.toArray() == pytest.approx(vectors[row.k], abs=1e-12)


def test_empty_vocabulary(spark):
    df = spark.createDataFrame([(1, "a")], "k int, t string")
    vocabulary = tfidf.fit_vocabulary(df, "t", tfidf.TermSettings(5))
    assert vocabulary.terms == []
    assert tfidf.tfidf_long(df, "t", vocabulary, ["k"]).columns == ["k", "term", "weight"]


@pytest.mark.parametrize("max_terms", [1, 2, 3, 5, 8, 13, 40, 500])
@pytest.mark.parametrize("min_documents", [1, 2])
def test_top_terms_equal_a_count_of_all_terms(spark, monkeypatch, max_terms, min_documents):
    rng = np.random.default_rng(max_terms)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 12) if x < 60) for _ in range(40)] + [None, "", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    settings = tfidf.TermSettings(max_terms, min_documents)
    every = [tuple(r) for r in tfidf.term_counts(df, "t", settings).collect()]
    kept = sorted((r for r in every if r[2] >= min_documents), key=lambda r: (-r[1], r[0]))[:max_terms]
    for tied in (1, 4, 1000):
        monkeypatch.setattr(tfidf, "TIED", tied)
        assert [tuple(r)[:3] for r in tfidf.top_terms(df, "t", settings).orderBy("term").collect()] == sorted(kept)


def test_pairs_of_rare_words_are_not_counted(spark, monkeypatch):
    texts = ["red red blue", "red blue", "blue red"] + [f"rare{i} other{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    monkeypatch.setattr(tfidf, "term_counts", None)  # the count of all terms is not needed here
    found = tfidf.kept_counts(df, "t", tfidf.TermSettings(2)).collect()
    assert {r["term"] for r in found} <= {"red", "blue", "red blue", "blue red", "red red"}
    assert {r["term"]: (r["term_count"], r["doc_count"]) for r in found if r["term_count"] > 3} == {"red": (4, 3)}
