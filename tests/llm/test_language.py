import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from triagework.llm import language
from triagework.llm.language import BUCKETS, codewords, fit, grams, gram_counts, keep_known, op6_language, predicted


def test_codewords_are_apart():
    assert codewords(0).shape == (0, 0) and codewords(1).shape == (1, 0)
    for n in (2, 3, 4, 6, 9, 25):
        code = codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n < 4 else code.shape[1] // 4)
        assert (np.abs(code.sum(axis=0)) < n).all()
    assert np.array_equal(codewords(9), codewords(9))


def test_grams():
    data = " ab ".encode()
    whole = [(data[i] << 16) | (data[i + 1] << 8) | data[i + 2] for i in range(2)]
    bits = (BUCKETS - 1).bit_length()
    assert np.concatenate(list(grams("Ab"))).tolist() == [(w * 2654435761 % (1 << 32)) >> (32 - bits) for w in whole]
    assert not list(grams(""))


def test_counts_equal_plain_counts(spark):
    rows = [("Ab cd", "x"), ("ab", "y"), (None, "x"), ("123", "x"), ("zz", None), ("ab", "y")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    plain = {}
    for text, lang in rows:
        if text and lang and any(c.isalpha() for c in text):
            for g in np.concatenate(list(grams(text)) or [np.zeros(0, int)]).tolist():
                plain[lang, g] = plain.get((lang, g), 0) + 1
    assert {(r.lang, r.bucket): r.n for r in gram_counts(docs).collect()} == plain


def test_held_out_accuracy(spark, small):
    got = op6_language(spark, small).toPandas().merge(pq.read_table(f"{small}/documents.parquet").to_pandas(), on="doc_id")
    known = got[got.held_out & got.lang.notna() & (got.lang_pred != "und")]
    assert len(got) == 200 and len(known) > 40
    assert (known.lang_pred == known.lang).mean() >= 0.95
    assert got.score.between(0, 1).all()


@pytest.fixture(scope="module")
def train(spark):
    rows = [("the thing that there this", "en"), ("der die das und nicht", "de"), ("que los las para como", "es")] * 5
    return spark.createDataFrame(rows, "text string, lang string")


def test_unknown_texts_and_clashing_columns(spark, train):
    model = fit(train)
    rows = [(None, "a"), ("", "b"), ("123 !?", "c"), ("the thing " * 20_000, "d"), ("UND NICHT DER", "e"), ("para que", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = {r.lang: (r.lang_pred, r.score, r.ambiguous) for r in predicted(docs, model).collect()}
    assert [got[k][0] for k in ("a", "b", "c", "d", "e", None)] == ["und", "und", "und", "en", "de", "es"]
    assert got["a"][1:] == got["c"][1:] == (0.0, True) and got["d"][2] is False


def test_stage_drops_unknown_texts_only(spark, train):
    docs = train.withColumn("score", F.lit("x")).union(
        spark.createDataFrame([(None, "en", "y"), ("42", "en", "z")], "text string, lang string, score string")
    )
    kept = keep_known(docs, F.lit(True))
    assert kept.schema == docs.schema and kept.count() == 15


def test_nothing_to_learn(spark, train):
    empty = train.limit(0)
    model = fit(empty)
    assert [r.lang_pred for r in predicted(train.limit(2), model).collect()] == ["und", "und"]
    assert predicted(empty, fit(train)).count() == 0
    one = fit(train.where("lang = 'en'"))
    assert {r.lang_pred for r in predicted(train, one).collect()} == {"en"}


def test_mixed_and_unlearned_texts_are_ambiguous(spark):
    rng = np.random.default_rng(2)
    parts = {"x": ["ba", "do", "ki", "lu"], "y": ["sch", "ung", "ver", "ein"], "z": ["que", "eau", "oi", "tre"]}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(40))
    train = spark.createDataFrame([(text(lang), lang) for lang in parts for _ in range(150)], "text string, lang string")
    clean = [(text(lang), lang) for lang in parts for _ in range(50)]
    mixed = [(text(a) + " " + text(b), "mixed") for a, b in ("xy", "yz", "xz") for _ in range(20)]
    strange = [("Это русский текст о погоде", "new"), ("これは日本語の文章です", "new"), ("gfpw jmpp wfgj pjgw", "new")]
    docs = spark.createDataFrame(clean + mixed + strange, "text string, lang string")
    got = predicted(docs, fit(train)).toPandas()
    assert got.ambiguous[got.lang.isin(["mixed", "new"])].mean() >= 0.95
    assert got.ambiguous[got.lang == "new"].all()
    assert got.ambiguous[got.lang.isin(list(parts))].mean() <= 0.04


def test_pieces_change_nothing(monkeypatch):
    text = "Où est la forêt ? " * 30
    whole = np.concatenate(list(grams(text))).tolist()
    monkeypatch.setattr(language, "CHUNK_CHARS", 11)
    assert np.concatenate(list(grams(text))).tolist() == whole


def test_signs_are_no_letters():
    assert not any(map(language.has_letter, ["", "½ ² ①", "12 _ ?", "\u0301"]))
    assert all(map(language.has_letter, ["é", "1a", "漢", "ª"]))
