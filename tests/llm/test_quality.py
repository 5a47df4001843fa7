import numpy as np
import pytest
from pyspark.sql import functions as F

from triagework.llm import quality
from triagework.llm.common import scratch
from triagework.llm.quality import (
    KEY_BITS,
    features,
    gumbel,
    is_target,
    keep_good,
    kth_largest,
    labelled_sample,
    log_ratios,
    resampled,
    shape_of,
)

def good():
    return F.col("quality") == 1


def text_of(rng, good):
    words = [f"{a}{b}" for a, b in zip(rng.choice(["ka", "lo", "mi", "ter"], 60), rng.choice(["n", "s", "la"], 60), strict=True)]
    return " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(0)
    rows = [(i, text_of(rng, i % 5 > 0), i % 7, "x") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, log_weight long, bucket string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 600, 2)], "doc_id long, quality int")
    return docs, labels


def test_junk_goes_and_clean_texts_stay(tables):
    got = {r.doc_id: r.kept for r in resampled(*tables, good()).collect()}
    assert len(got) == 600
    assert not any(got[i] for i in range(0, 600, 5))
    assert sum(got[i] for i in range(600) if i % 5) >= 0.98 * 480


def test_stage_keeps_columns_and_agrees(tables):
    docs, labels = tables
    kept = keep_good(docs, labels, good())
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in resampled(docs, labels, good()).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == ids
    assert kept.join(docs, docs.columns, "left_anti").count() == 0


def test_ratios_equal_plain_counts(spark, tables):
    docs, labels = tables
    sample = scratch(labelled_sample(labels, good()), "s")
    chosen = {r["__labelled"] for r in sample.where("__target and not __cut").collect()}
    raw, target = np.zeros(512), np.zeros(512)
    for r in docs.collect():
        for b in features(r.text, 512):
            raw[b] += 1
            target[b] += r.doc_id in chosen
    expected = np.log((target * raw.sum() / target.sum() + 20) / (raw + 20))
    assert np.allclose(log_ratios(docs, sample, 512), expected)


def test_top_k_is_exact(tables):
    docs, labels = tables
    for k in (0, 1, 17, 600, 1000):
        rows = resampled(docs, labels, good(), k=k).collect() if k < 700 else None
        if rows is None:
            continue
        order = sorted((r.sampling_key for r in rows), reverse=True)
        assert sum(r.kept for r in rows) == k
        assert all(r.kept == (k > 0 and r.sampling_key >= order[k - 1]) for r in rows)


def test_kth_largest_with_ties_and_few_rows(spark):
    keys = scratch(spark.createDataFrame([(1.5,), (1.5,), (-3.25,), (0.0,)], "sampling_key double"), "k")
    assert [kth_largest(keys, k) / 2.0**KEY_BITS for k in (1, 2, 3, 4)] == [1.5, 1.5, 0.0, -3.25]
    assert kth_largest(keys, 0) == (1 << 63) - 1 and kth_largest(keys, 5) is None


def test_noise_is_gumbel_and_repeats(spark):
    noise = np.array([r[0] for r in spark.range(20_000).select(gumbel("id")).collect()])
    assert abs(noise.mean() - 0.5772) < 0.05 and abs(noise.var() - np.pi**2 / 6) < 0.1
    assert noise[:50].tolist() == [r[0] for r in spark.range(50).select(gumbel("id")).collect()]


def test_shapes_and_features():
    assert [shape_of(w) for w in ("!!", "12", "abc", "ABC", "A", "Abc", "aBc", "_")] == [0, 1, 2, 3, 4, 5, 6, 6]
    assert len(features(None, 8)) == len(features("  ", 8)) == 0
    assert len(features("a", 64)) == 2 and len(features("a a", 64)) == 4 and len(features("a b", 64)) == 5
    assert np.array_equal(features("x " * 40_000, 64), features("x " * 40_000, 64))


def test_texts_with_words_of_rejected_texts_go(spark):
    rng = np.random.default_rng(1)
    bad = [f"vile{c}" for c in "abcdefghijklmnop"]
    rows = []
    for i in range(1200):
        words = [text_of(rng, True) for _ in range(4)]
        if i % 6 == 0:
            words += rng.choice(bad, 2, replace=False).tolist()
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(0, 1200) if i % 4], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in resampled(docs, labels, is_target()).collect()}
    toxic = [i for i in range(0, 1200, 6)]
    assert sum(got[i] for i in toxic) <= 0.05 * len(toxic)
    assert sum(got[i] for i in range(1200) if i % 6) >= 0.98 * 1000
    assert {r.doc_id for r in keep_good(docs, labels, is_target()).collect()} == {i for i, k in got.items() if k}


def test_odd_rows_and_empty_tables(spark, tables):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "y " * 60_000), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    assert resampled(docs, none, good()).where("kept").count() == 5
    assert resampled(docs, labels, good()).count() == 5
    assert keep_good(docs.limit(0), labels, good()).count() == 0


def test_sample_is_the_top_k(spark):
    rows = [(i, ("good words here " * 3 if i % 3 else "xx yy zz ") + f"n{i % 11}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = resampled(docs, labels, is_target()).collect()
    kept = sorted((r.sampling_key for r in got if r.kept), reverse=True)
    assert kept == sorted((r.sampling_key for r in got), reverse=True)[: len(kept)] and 100 < len(kept) <= 205
    few = resampled(docs, labels, is_target(), k=17).collect()
    assert sorted(r.sampling_key for r in few if r.kept) == sorted(r.sampling_key for r in few)[-17:]


def test_pieces_change_nothing(monkeypatch):
    text = "Some words, here\tand 12 there there there. " * 40 + "end"
    whole = sorted(features(text, 1 << 16).tolist())
    assert "".join(quality.pieces(text, 100)) == text and len(list(quality.pieces(text, 100))) > 10
    monkeypatch.setattr(quality, "WORDS_AT_ONCE", 7)
    monkeypatch.setattr(quality, "pieces", lambda t: iter([t[:43], t[43:86], t[86:]]))
    assert sorted(features(text, 1 << 16).tolist()) == whole
