import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from triagework.llm import rank_bpe
from triagework.llm.rank_bpe import RankBpe, decode, encode, op12_rank_bpe, read_ranks, round_trips

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = [
    "a", "e", " ", "  ", "\n", "\t", "th", "the", "'s", "'ll", "12", "é", "漢", "😀", "́", "\xa0", "\x1c", "!", "...",
    "\r\n", "A", "ing", "\x00", "़", "²", "<|endoftext|>", "\x85", "​", "字", "好",
]
LONG = [
    "a" * 20_000, " " * 3_000, "ab" * 5_000, "\n" * 3_000, "word " * 5_000, "thequickbrownfoxjumps" * 100,
    "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=2_000)),
    "".join(random.Random(4).choices("的一是了我不在人有这中国大学生", k=1_000)),
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    with RankBpe(PATH) as made:
        yield made


def ids_of(bpe, texts):
    ids, counts = bpe.encode_batch(texts)
    assert bpe.decode_batch(ids, counts) == [(t or "").encode() for t in texts]
    ends = [0, *counts.cumsum().tolist()]
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_equals_the_library_on_odd_texts(bpe, library):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(3000)]
    assert ids_of(bpe, texts) == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", LONG)
def test_equals_the_library_on_long_pieces(bpe, library, text):
    assert ids_of(bpe, [text]) == [library.encode_ordinary(text)]


@settings(max_examples=100, deadline=None)
@given(text=st.text(max_size=60))
def test_equals_the_library_on_any_text(bpe, library, text):
    assert ids_of(bpe, [text]) == [library.encode_ordinary(text)]


def test_single_rows_and_lists_agree(bpe, monkeypatch):
    pieces = [p.encode() for p in ["entrepreneurship", "aaaaaaa", "Donaudampfschiff", "xyzzyxyzzy", "ab" * 20]]
    want = bpe.encode_pieces(pieces)
    monkeypatch.setattr(rank_bpe, "LONG_BYTES", 2)
    monkeypatch.setattr(RankBpe, "cut_apart", lambda self, piece: [piece])
    got = bpe.encode_pieces(pieces)
    assert got.ids.tolist() == want.ids.tolist() and got.lengths.tolist() == want.lengths.tolist()


def test_cuts_are_where_no_token_crosses(bpe):
    for text in LONG:
        piece = text[:600].encode()
        parts = bpe.cut_apart(piece)
        assert b"".join(parts) == piece
        borders = set(np.cumsum([len(p) for p in parts])[:-1].tolist())
        crossed = {
            k for i in range(len(piece)) for j in range(i + 2, min(len(piece), i + bpe.longest) + 1)
            if piece[i:j] in bpe.ranks for k in range(i + 1, j)
        }
        assert borders == set(range(1, len(piece))) - crossed


def test_forgetting_changes_nothing(bpe):
    texts = ["some words here", "and there"]
    before = ids_of(bpe, texts)
    bpe.forget()
    assert ids_of(bpe, texts) == before


def test_unknown_ids_are_an_error(bpe):
    for wrong in (-1, len(bpe.known)):
        with pytest.raises(ValueError):
            bpe.decode_batch(np.array([5, wrong]), np.array([2]))


def test_round_trip(spark, library):
    texts = [None, "", "Hello  world\n", "<|endoftext|>x", "漢字", *LONG[:3], "Hello  world\n"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids long")
    coded = encode(docs, PATH)
    got = {r.doc_id: r.ids for r in coded.collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.bytes) for r in decode(coded, PATH).collect()} == {
        i: (t or "").encode() for i, t in enumerate(texts)
    }
    parts = spark.createDataFrame([(1, got[4][:1]), (2, None), (3, [])], "doc_id int, ids array<int>")
    assert {r.doc_id: bytes(r.bytes) for r in decode(parts, PATH).collect()} == {
        1: library.decode_bytes(got[4][:1]), 2: b"", 3: b"",
    }


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode(empty, PATH).count() == round_trips(empty, PATH).count() == 0
    assert decode(encode(empty, PATH), PATH).count() == 0


def test_query_equals_the_library(spark, small, library):
    rows = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r.doc_id: r for r in op12_rank_bpe(spark, small).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
