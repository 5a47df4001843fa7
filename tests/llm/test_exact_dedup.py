import hashlib

import pytest

from triagework.llm import exact_dedup
from triagework.llm.exact_dedup import ContentTable, drop_exact_copies, exact_groups

ROWS = [
    (1, "Hello  World", "a"),
    (2, "hello  world", "b"),
    (3, "hello world", "c"),
    (4, None, "d"),
    (5, "", None),
    (6, "É", "e"),
    (7, "é", "f"),
    (8, "x" * 200_000, "g"),
    (9, "X" * 200_000, "h"),
    (None, "hello world", "i"),
    (10, "tie", "j"),
    (10, "tie", "j"),
    (-5, "\u0000 a", "k"),
]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(lower(text), []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = groups[lower(text)]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), hashlib.sha256(lower(text).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture()
def docs(spark):
    schema = "doc_id long, text string, `__hash` string"
    return spark.createDataFrame(ROWS, schema).repartition(3)


@pytest.mark.parametrize("budget", [1 << 20, 300])
def test_groups_equal_brute_force(docs, budget):
    got = exact_groups(docs, budget=budget).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(ROWS)
    for sha in {r.text_sha256 for r in got}:
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("budget", [1 << 20, 300])
def test_dropping_keeps_the_row_with_the_largest_id_as_it_was(docs, budget):
    kept = drop_exact_copies(docs, budget=budget)
    assert kept.schema == docs.schema
    got = {tuple(r) for r in kept.collect()}
    assert len(got) == kept.count() == len({lower(r[1]) for r in ROWS})
    assert got <= set(ROWS)
    assert {(2, "hello  world", "b"), (3, "hello world", "c"), (9, "X" * 200_000, "h"), (10, "tie", "j")} <= got


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(empty).count() == 0
    assert drop_exact_copies(empty).count() == 0


def test_hot_text_is_folded_before_the_shuffle(spark):
    docs = spark.range(9000).selectExpr("id as doc_id", "if(id % 3 = 0, 'Hot text', concat('t', id)) as text")
    got = exact_groups(docs)
    assert got.where("group_size = 3000 and keep_id = 8997").count() == 3000
    assert got.where("kept").count() == 6001


def test_table_compares_contents_not_hashes():
    table = ContentTable()
    places = [table.place(7, t)[0] for t in (b"a", b"b", b"A", b"c")]
    assert places == [0, 1, 0, 2]
    for i in range(5000):
        assert table.place(i % 10, str(i).encode())[0] == 3 + i


def test_spill_files_are_closed(docs, monkeypatch):
    made = []
    real = exact_dedup.tempfile.TemporaryFile
    monkeypatch.setattr(exact_dedup.tempfile, "TemporaryFile", lambda **k: made.append(real(**k)) or made[-1])
    groups = exact_dedup.Groups()
    for i in range(400):
        groups.add(exact_dedup.content_hash(str(i).encode()), str(i).encode(), [i], 1, (i, i), None)
    tables = list(exact_dedup.grouped(groups.records(None), None, 5000))
    assert len(tables) > 1 and sum(len(t.texts) for t in tables) == 400
    assert made and all(f.closed for f in made)
