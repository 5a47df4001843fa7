import hashlib
import random
import zlib

import numpy as np
import pytest

from triagework.llm.periodic_runs import (
    WaveletTree,
    numbered,
    op11_periodic_runs,
    periodic_runs,
    runs_of,
    with_planted_runs,
)


def brute(words, min_length=6, min_exponent=4):
    """All runs as (start, period, end), by comparing every word with the one a period on."""
    found, n = {}, len(words)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(min_length, min_exponent * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, q, e) for (s, e), q in found.items())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    words = planted(doc_id, words)
    runs = brute(words)
    drop = {i for s, q, e in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[2], r[0], r[1]), default=None)
    lines = "".join(f"{s},{e - s},{q}\n" for s, q, e in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s, q, e = best or (None, None, None)
    return (
        len(runs), s, None if best is None else e - s, q, None if best is None else 1000 * (e - s) // q,
        sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


def words_of_parts(rng, n):
    words = []
    while len(words) < n:
        part = [rng.choice("aab") for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.4:
            part = part * rng.randint(1, 3) + ["c"]
        words += part * rng.randint(1, 7)
        if rng.random() < 0.3:
            words.append(rng.choice("xyab"))
    return words


@pytest.mark.parametrize("exponent", [3, 4, 5])
def test_equals_brute_force(exponent):
    rng = random.Random(exponent)
    for _ in range(700):
        n = rng.randint(0, 110)
        words = rng.choice([lambda: rng.choices("ab", k=n), lambda: rng.choices("aaaaaab", k=n), lambda: words_of_parts(rng, n)])()
        _, codes, _ = numbered([" ".join(words).encode()])
        start, end, period = runs_of(codes, len(words), 6, exponent)
        got = list(zip(start.tolist(), period.tolist(), end.tolist(), strict=True))
        assert got == brute(words, 6, exponent), words


def test_runs_stay_within_their_texts():
    texts = [b"a b a b a b", b"a b a b a b", b"b a b a", b"", None, b"x " * 7, b"x " * 5]
    _, codes, ends = numbered(texts)
    start, end, period = runs_of(codes, 7)
    assert (start - ends[5]).tolist() == [0] and (end - start).tolist() == [7] and period.tolist() == [1]


def test_range_successor():
    rng = np.random.default_rng(2)
    values = rng.permutation(500)[:300]
    tree = WaveletTree(values, 500)
    low = rng.integers(0, 300, 2000)
    high = low + rng.integers(0, 301 - low)
    least = rng.integers(0, 520, 2000)
    least = np.minimum(least, 511)
    want = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(low, high, least, strict=True)]
    assert tree.successor(low, high, least).tolist() == want


def test_fewer_than_three_periods_are_refused():
    with pytest.raises(ValueError):
        runs_of(np.zeros(10, np.int64), 10, 6, 2)


def test_long_texts():
    for words in (["a"] * 40_000, "a b c d e f g".split() * 6_000):
        _, codes, _ = numbered([" ".join(words).encode()])
        start, end, period = runs_of(codes, len(words))
        assert (start.tolist(), end.tolist()) == ([0], [len(words)]) and period[0] == len(set(words))


def test_operator_returns_spans_and_texts(spark):
    texts = [(1, "go " + "la la land " * 4 + "now on\x1fx"), (2, None), (3, ""), (3, " \t\n\x0b"), (None, "z " * 9), (3, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, runs string")
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()]
    assert got == [
        (1, [(1, 12, 3)], "go la la land now on\x1fx"),
        (2, [], ""), (3, [], ""), (3, [], ""), (None, [(0, 9, 1)], "z"), (3, [], ""),
    ]
    assert periodic_runs(docs.limit(0)).count() == 0


def test_planted_runs(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 60)))) for i in range(400)] + [(None, "a b"), (4007, None)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, words int, id int, h int")
    got = {r.doc_id: r.text for r in with_planted_runs(docs).collect()}
    for i, t in rows:
        assert got[i].split() == (planted(i, (t or "").split()) if i is not None else ["a", "b"])


def test_query_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 20000").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op11_periodic_runs(spark, small).collect()}
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    for r in docs:
        assert got[r.doc_id] == expected(r.doc_id, r.text), r.doc_id
    assert sum(v[0] > 0 for v in got.values()) > 5
