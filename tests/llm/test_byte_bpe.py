import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from triagework.llm.byte_bpe import decode, encode, load, round_trips

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "e", " ", "  ", "\n", "\t", "th", "the", "'s", "'ll", "12", "é", "漢", "😀", "́", "\xa0", "\x1c", "!", "...",
    "\r\n", "A", "ing", "\x00", "़", "²", "<|endoftext|>",
]
LONG = ["a" * 30_000, " " * 5_000, "ab" * 9_000, "\n" * 3_000, "word " * 5_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(texts):
    ids, counts = load(PATH).encode_batch(texts)
    ends = [0, *counts.cumsum().tolist()]
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_equals_the_library_on_odd_texts(library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(3000)] + LONG
    assert ids_of(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_library_on_any_text(text):
    library = Tokenizer.from_file(PATH)
    assert ids_of([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, library):
    texts = [None, "", "Hello  world\n", "<|endoftext|>x", *LONG, "Hello  world\n"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids long")
    coded = encode(docs, PATH)
    got = {r.doc_id: r.ids for r in coded.collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in decode(coded, PATH).collect()} == {i: t or "" for i, t in enumerate(texts)}
    for r in round_trips(docs, PATH).collect():
        assert r.n_tokens == len(got[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, got[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode(empty, PATH).count() == round_trips(empty, PATH).count() == 0
    assert decode(encode(empty, PATH), PATH).count() == 0


def test_forgetting_changes_nothing():
    bpe = load(PATH)
    texts = ["some words here", "and there"]
    before = ids_of(texts)
    bpe.forget()
    assert ids_of(texts) == before
