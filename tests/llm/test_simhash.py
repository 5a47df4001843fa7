import re

import numpy as np
import pytest
import xxhash

from triagework.llm.common import connected_components, forest, scratch
from triagework.llm.simhash import (
    drop_near_duplicates,
    fingerprint,
    flips,
    near_duplicates,
    near_links,
    prefix_bits,
    shared_variants,
    shingle_hashes,
)


def plain_fingerprint(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (int(prints[i]) ^ int(prints[j])).bit_count() <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize(
    "text", [None, "", " \n", "One", "A b\x1cc\td  e", "a b c d a b c d a b c d", "é " * 9, "w" * 90_000, "x y z " * 9000]
)
def test_fingerprint(text):
    assert fingerprint(shingle_hashes(text, 4)) == plain_fingerprint(text)


def clustered_prints(seed, n=60):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = int(rng.integers(0, 1 << 63))
        out.append(base)
        for _ in range(int(rng.integers(0, 5))):
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                base ^= 1 << int(bit)
            out.append(base)
    return sorted(set(out))


def linked(prints, pairs):
    """Components, as sets, that the given pairs make."""
    at = {p: i for i, p in enumerate(prints)}
    low = list(range(len(prints)))
    for _ in prints:
        for a, b in pairs:
            low[at[a]] = low[at[b]] = min(low[at[a]], low[at[b]])
    return low


@pytest.mark.parametrize("at_once", [1 << 20, 3000])
def test_shared_variants_find_all_links(monkeypatch, at_once):
    monkeypatch.setattr("triagework.llm.simhash.VARIANTS_AT_ONCE", at_once)
    prints = clustered_prints(3)
    array = np.array(prints, np.uint64)
    pairs = set()
    for a, b in shared_variants(array, np.full(len(prints), 2, np.int8), 64):
        pairs |= set(zip(array[a].tolist(), array[b].tolist(), strict=True))
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    assert linked(prints, pairs) == brute_components(prints)


@pytest.mark.parametrize("block_rows", [1 << 18, 5])
def test_links_over_blocks(spark, block_rows):
    prints = clustered_prints(4) + [0, 1, 3, 1 << 63 | 1, (1 << 64) - 1]
    prints = sorted(set(prints))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    table = scratch(spark.createDataFrame(signed, "fingerprint long"), "t")
    pairs = {(r.a % (1 << 64), r.b % (1 << 64)) for r in near_links(table, block_rows=block_rows).collect()}
    assert linked(prints, pairs) == brute_components(prints)


def test_flips_and_prefix():
    assert len(flips(64, 2)) == 2081 and len(set(flips(64, 2))) == 2081
    assert prefix_bits(100, 2) == 10 and prefix_bits(1 << 24, 2) > 12


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{int(x)}" for x in rng.integers(0, 10_000, n)]


def test_documents(spark):
    base = words(1, 300)
    near = [*base[:299], "changed"]
    texts = [" ".join(words(9, 200)), " ".join(base), " ".join(near), " ".join(base).upper(), "", None, "one", "one"]
    rows = [(10 - i, t, "x") for i, t in enumerate(texts)] + [(None, texts[1], "y"), (10, texts[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = near_duplicates(docs).collect()
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    roots = brute_components(prints)
    smallest = {}
    for (doc_id, _, _), r in zip(rows, roots, strict=True):
        if doc_id is not None:
            smallest[r] = min(doc_id, smallest.get(r, doc_id))
    expected = sorted((str(d), f"{p:016x}", smallest[r]) for (d, _, _), p, r in zip(rows, prints, roots, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == expected
    kept = drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(smallest.values())


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "f g h i j k"), (None, "a b c d e")], "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(docs).collect()} == {None}
    assert sorted(r.text for r in drop_near_duplicates(docs).collect()) == ["a b c d e", "f g h i j k"]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == drop_near_duplicates(empty).count() == 0


def test_hot_fingerprint_and_many_near_copies(spark):
    base = words(2, 400)
    texts = [" ".join([*base[:i], "new", *base[i + 1 :]]) for i in range(0, 400, 8)] + [" ".join(base)] * 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [plain_fingerprint(t) for t in texts]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(prints)


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200), (202, 201), (200, 202)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys((200, 201, 202), 200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    a, b = forest(np.array([5, 4, 9, 7]), np.array([4, 3, 8, 7]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(4, 3), (5, 3), (9, 8)]
