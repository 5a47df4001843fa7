import duckdb
import numpy as np
import pytest

from tools.check_oracles import compare
from triagework.llm.ego_join import OP3_SQL, Sequences, near_vectors, op3_ego_join


def brute(rows, cosine):
    units = []
    for _, label, v in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and units[i] is not None and units[j] is not None and rows[i][1] == rows[j][1]:
                if len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                    links[i].add(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids, default=None)))
    return sorted(out, key=repr)


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        base = rng.normal(size=d)
        for k in range(int(rng.integers(1, 5))):
            out.append((10 * i + k, int(rng.integers(0, 3)), (base + rng.normal(size=d) * 0.12).astype("f4").tolist()))
    return out


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_equals_brute_force(spark, block_rows):
    rows = vectors(1, 60, 6)
    rows += [(2000 + i, 1, rows[0][2]) for i in range(5)] + [(3000, 1, [2 * x for x in rows[0][2]]), (3001, 1, rows[0][2][:4])]
    rows += [(4000, None, rows[0][2]), (4001, 1, None), (4002, 1, []), (4003, 1, [0.0] * 6), (4004, 1, [1.0, None] * 3)]
    rows += [(4005, 1, [float("nan")] * 6), (4006, 1, [float("inf")] + [0.0] * 5), (None, 1, rows[0][2]), (2000, 1, rows[0][2])]
    rows += [(5000, 2, [-1.0]), (5001, 2, [1.0]), (5002, 2, [3.0])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, node string")
    got = near_vectors(docs.repartition(3), block_rows=block_rows).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute(
        [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows], 0.98
    )
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_no_rows(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_many_near_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, 0, (base + rng.normal(size=16) * 0.02).astype("f4").tolist()) for i in range(700)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), block_rows=100).collect()
    assert {r.component_id for r in got} == {0} and sum(r.n_links for r in got) == 700 * 699


def test_sequences_find_every_pair():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x[np.lexsort(np.floor(x / 0.2).T[::-1])]
    want = set(zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)), strict=True))
    got = [p for i, j in Sequences(x, x, np.eye(3)[:, :2], 0.98, True).links() for p in zip(i, j, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
    y = x[::-1]
    cross = [p for i, j in Sequences(x, y, np.eye(3)[:, :2], 0.98, False).links() for p in zip(i, j, strict=True)]
    assert len(cross) == (x @ y.T >= 0.98).sum() == len(set(cross))


def test_query_equals_its_sql(spark, small):
    connection = duckdb.connect()
    connection.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    assert compare(op3_ego_join(spark, small).toPandas(), connection.execute(OP3_SQL).df()).startswith("ok")
