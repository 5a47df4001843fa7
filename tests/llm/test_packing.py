import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from triagework.llm.common import scratch
from triagework.llm.packing import (
    MARK,
    SETTINGS,
    WordTokens,
    best_filling,
    configurations,
    linear_groups,
    load,
    pack_documents,
    packed,
    packing_runs,
    sequences,
    tokenized_pieces,
)

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", " ", "  ", "\n", "the", "'s", "12", "é", "Σ", "İ", "́", "\xa0", "😀", "!?", "<|endoftext|>", "Th", "\x00"]
LONG = ["a" * 30_000, " " * 5_000, "ab " * 9_000, "\n" * 3_000]


def fill(counts, capacity, setting):
    runs, n = packing_runs(dict(counts), capacity, *setting)
    seen, rooms = collections.Counter(), collections.defaultdict(list)
    for length, rank, number, first, per, offset in runs.tolist():
        assert rank == seen[length]
        seen[length] += number
        for k in range(number):
            rooms[first + k // per].append((offset + k % per * length, length))
    assert seen == collections.Counter({k: v for k, v in counts.items() if v})
    assert set(rooms) == set(range(n))
    for pieces in rooms.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return n


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("setting", [*SETTINGS, (4, 1 / 8), (1, 0.0)])
@pytest.mark.parametrize("kind", ["mixed", "hot", "small", "large", "none"])
def test_every_piece_has_its_place(kind, setting):
    rng = random.Random(kind)
    lengths = {
        "mixed": [rng.randint(1, 100) for _ in range(500)],
        "hot": [37] * 400 + [rng.randint(1, 100) for _ in range(100)],
        "small": [rng.randint(1, 5) for _ in range(300)],
        "large": [rng.randint(60, 100) for _ in range(300)],
        "none": [],
    }[kind]
    assert fill(collections.Counter(lengths), 100, setting) >= -(-sum(lengths) // 100)


def test_as_few_sequences_as_best_fit():
    rng = random.Random(5)
    for low, high in ((1, 100), (20, 70), (1, 30)):
        lengths = [rng.randint(low, high) for _ in range(1000)]
        ours = min(fill(collections.Counter(lengths), 100, s) for s in SETTINGS)
        assert ours <= best_fit_decreasing(lengths, 100) * 1.005


def test_groups_have_equal_cardinality_and_round_up():
    groups = linear_groups({9: 5, 7: 3, 4: 4}, 3)
    assert groups == [(9, [[9, 0, 4], [9, 4, 1], [7, 0, 3]]), (4, [[4, 0, 4]])]


def test_filling_and_configurations():
    assert best_filling([50, 30, 20], [1, 5, 5], 70) == [1, 0, 1]
    assert best_filling([6, 4], [0, 1], 10) == [0, 1]
    used = list(configurations([6, 4], [2, 3], 10))
    assert used == [([1, 1], 2), ([0, 1], 1)]


def test_ids_equal_the_library():
    rng = random.Random(2)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(3000)] + LONG + [None]
    ids, counts = load(PATH).encode_batch(texts, 1)
    ends = [0, *counts.cumsum().tolist()]
    library = Tokenizer.from_file(PATH)
    for text, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_documents_are_packed_whole(spark):
    texts = [None, "", "one two three", *LONG, "one two three"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length long")
    library = Tokenizer.from_file(PATH)
    pieces = scratch(tokenized_pieces(docs, PATH, 4096), "pieces")
    rows = sorted(pieces.collect(), key=lambda r: (r.doc_id, r.piece))
    for i, text in enumerate(texts):
        mine = [r for r in rows if r.doc_id == i]
        assert [x for r in mine for x in r.ids] == [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in mine] == [4096 * k for k in range(len(mine))]
        assert all(r.length == len(r.ids) == 4096 for r in mine[:-1])
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    placed = packed(pieces, ["doc_id", "piece"], 4096)
    joined = {r.sequence_id: r.ids for r in sequences(placed).collect()}
    for r in placed.collect():
        assert joined[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, joined.values())) == sum(r.length for r in rows)


def test_no_rows(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = pack_documents(docs, PATH, capacity=6).collect()
    assert len(got) == 4
    assert len({(r.sequence_id, r.offset) for r in got}) == 4


def test_units_of_a_batch_are_cut_together():
    words = WordTokens(PATH)
    calls, cut = [], words.cut
    words.cut = lambda text: calls.append(text) or cut(text)
    texts = [f"wörd{i} plain{i}, Plain{i}!" for i in range(500)]
    ids, counts = words.encode_batch(texts, 1)
    assert len(calls) <= 1
    library = Tokenizer.from_file(PATH)
    for text, row in zip(texts, np.split(ids, counts.cumsum()[:-1]), strict=True):
        assert row.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_ids_of_any_ascii_and_of_the_mark_equal_the_library():
    rng = random.Random(3)
    chars = [*map(chr, range(128)), *" '''stm \n", MARK, "é"]
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 40))) for _ in range(3000)]
    ids, counts = load(PATH).encode_batch(texts, 1)
    library = Tokenizer.from_file(PATH)
    for text, row in zip(texts, np.split(ids, counts.cumsum()[:-1]), strict=True):
        assert row.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
