import duckdb
import numpy as np
import pytest

from docloom.llm import embeddings as op


def brute(rows):
    unit = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, dtype=np.float64)
            unit[k] = (label, len(v), a / np.abs(a).max())
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = list(unit)
    for p in keys:
        for q in keys:
            if p < q and unit[p][:2] == unit[q][:2]:
                a, b = unit[p][2], unit[q][2]
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    n[p] += 1
                    n[q] += 1
                    root[max(find(p), find(q))] = min(find(p), find(q))
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted([(i, n[k], least.get(find(k), i), least.get(find(k), i) == i) for k, (i, *_) in enumerate(rows)], key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def cloud(seed, n=300, d=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d))
    v = centres[r.integers(0, 12, n)] + r.normal(size=(n, d)) * r.choice([0.02, 0.1, 0.2], (n, 1))
    return [(int(i), [float(x) for x in v[i] * 10.0 ** r.integers(-3, 4)], int(r.integers(0, 3))) for i in r.permutation(n)]


ODD = [
    (1001, None, 1), (1002, [0.0] * 16, 1), (1003, [1.0] * 16, None), (1004, [float("nan")] + [1.0] * 15, 1), (1005, [float("inf")] * 16, 1), (1006, [None] + [1.0] * 15, 1), (1007, [], 1),
    *((2000 + i, [1.0] * 16, 1) for i in range(40)), (3000, [1e200] * 16, 1), (3001, [1e-200] * 16, 1), (3001, [1e-200] * 16, 1), (None, [1.0] * 16, 2), (4000, [-1.0] * 16, 2),
]
SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize(("seed", "block_rows", "leaf"), [(1, 1000, 128), (2, 20, 3)])
def test_brute_force(spark, monkeypatch, seed, block_rows, leaf):
    monkeypatch.setattr(op, "LEAF_ROWS", leaf)
    rows = cloud(seed) + ODD
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", vec string").repartition(3)
    assert got(op.near_duplicates(df, block_rows=block_rows)) == brute(rows)


def test_many_intervals(spark, monkeypatch):
    """Small blocks, two parts of an interval and two partners of a block: the recursion goes several levels deep."""
    for name, value in (("PARTS", 2), ("PARTNERS", 2), ("LEAF_ROWS", 3)):
        monkeypatch.setattr(op, name, value)
    rows = cloud(5, 400) + ODD
    assert got(op.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), block_rows=7)) == brute(rows)


@pytest.mark.parametrize("rows", [[], ODD[:7], [(1, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.001], 1), (3, [1.0, 2.0, 0.0], 1)]])
def test_small_tables(spark, rows):
    assert got(op.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_sql_gives_the_same(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = c.sql(op.ORACLE_SQL["op9_embeddings"]).fetchall()
    assert got(op.op9_embeddings(spark, "/root/testdata/sf0.001")) == sorted(want, key=str)
