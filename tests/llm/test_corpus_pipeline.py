import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from triagework.llm.common import lowered, scratch
from triagework.llm.simhash import fingerprint, shingle_hashes


@pytest.fixture(scope="module")
def stages(spark, small):
    """What every stage was given and returned."""
    docs, seen = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = scratch(stage(spark, docs, small), name)
        seen.append((name, docs, out))
        docs = out
    return seen


def test_names_and_columns(stages):
    assert [n for n, _, _ in stages] == ["quality", "language", "exact_copies", "near_copies", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
        assert after.join(before, ["doc_id", "text"], "left_anti").count() == 0


def test_clean_documents_stay_and_junk_goes(spark, small, stages):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = {r.doc_id for r in stages[0][2].select("doc_id").collect()}
    rows = labels.collect()
    clean = [r.doc_id in kept for r in rows if r.quality == 1 and r.toxic == 0]
    junk = [r.doc_id in kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.95 * len(clean) and sum(junk) < 0.95 * len(junk)


def test_language_drops_little(stages):
    _, before, after = stages[1]
    assert after.count() >= 0.95 * before.count()


def test_exact_copies(stages):
    _, before, after = stages[2]
    best = {}
    for r in before.collect():
        best[lowered(r.text)] = max(r.doc_id, best.get(lowered(r.text), r.doc_id))
    assert sorted(best.values()) == sorted(r.doc_id for r in after.collect())


def test_near_copies(stages):
    _, before, after = stages[3]
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    prints = [fingerprint(shingle_hashes(r.text, 4)) for r in rows]
    low = list(range(len(rows)))
    for _ in rows:
        for i, p in enumerate(prints):
            low[i] = min(low[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 4)
        low = [low[i] for i in low]
    assert sorted({rows[i].doc_id for i in low}) == sorted(r.doc_id for r in after.collect())


def test_packing(stages):
    _, before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect()}
    got, rooms = {}, {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        rooms.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for pieces in rooms.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 4096


def test_run_returns_the_last_stage(spark, small, stages):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    digest = lambda rows: hashlib.sha256(repr(sorted(map(key, rows))).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, small).collect()) == digest(stages[4][2].collect())


def test_stages_take_empty_and_odd_documents(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, block long"
    odd = [
        (None, None, None, None, None, None, None),
        (1, "", "en", "s", 0, "x", 1),
        (1, "", "en", "s", 0, "x", 1),
        (2, "the and that of in " * 9_000, "en", "s", 3, "y", 2),
        (3, "!!! ???", None, "s", 3, "z", 3),
    ]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = scratch(stage(spark, docs, small), name)
            if name != "packing":
                assert out.columns == docs.columns
            docs = out if rows == [] or name in ("exact_copies",) else docs
