import numpy as np
import pyarrow.parquet as pq
import pytest

from docloom.llm import neighbours as op

SCHEMA = "vec_id long, embedding array<double>, label int"


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, k, every):
    rows = [r for r in rows if r[0] is not None and usable(r[1])]
    out = []
    for i, (query, q, *_) in enumerate(rows):
        if query % every:
            continue
        met = [(-float(np.einsum("bcd,bd->bc", np.array([[v]]), np.array([q]))[0, 0]), m) for j, (m, v, *_) in enumerate(rows) if i != j and len(v) == len(q)]
        out += [(query, rank, m, -s) for rank, (s, m) in enumerate(sorted(x for x in met if x[0] == x[0])[:k], 1)]
    return sorted(out)


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def cloud(seed, n=240, d=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, d))
    v = centres[r.integers(0, 9, n)] + r.normal(size=(n, d)) * r.choice([0.0, 0.1, 0.5], (n, 1))
    return [(int(i), [float(x) for x in v[i] * r.choice((0.1, 1, 3))], 1) for i in r.permutation(n)]


ODD = [
    (1000, None, 1), (1005, [0.0] * 12, 1), (1010, [float("nan")] + [1.0] * 11, 1), (1015, [float("inf")] * 12, 1), (1020, [None] + [1.0] * 11, 1), (1025, [], 1), (None, [1.0] * 12, 1),
    *((2000 + i, [1.0] * 12, 1) for i in range(60)), (3000, [1.0, 2.0], 2), (3001, [2.0, 1.0], 2), (3005, [-1.0, 0.0], None), (3010, [1.0, 2.0, 3.0], 1), (4000, [0.0] * 11 + [-0.0], 1),
    (4005, [1e-200] * 12, 1), (4010, [1e200] + [0.0] * 11, 1), (4010, [1e200] + [0.0] * 11, 1), (4015, [-1.0] * 12, 1), (4015, [2.0] * 12, 1), (4020, [1.0] * 11 + [-0.0], 1), (4021, [1.0] * 11 + [0.0], 1),
]


@pytest.mark.parametrize(("seed", "shard_rows", "query_rows", "k"), [(1, 10_000, 10_000, 20), (2, 60, 15, 20), (3, 25, 10_000, 3)])
def test_brute_force_with_a_beam_as_wide_as_a_shard(spark, seed, shard_rows, query_rows, k):
    """Every node is reached from the entry, so such a beam meets all nodes and the results are exact, ties and copies included."""
    rows = cloud(seed) + ODD
    df = spark.createDataFrame([(*r, "x", b"y") for r in rows], SCHEMA + ", key string, vector binary").repartition(3)
    assert got(op.nearest(df, k, "id % 5 = 0", shard_rows=shard_rows, query_rows=query_rows, beam=400)) == brute(rows, k, 5)


@pytest.mark.parametrize("rows", [[], ODD[:7], [(0, [1.0, 2.0], 1)], [(0, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (7, [3.0], 1)], [(5, [1.0], 1)] * 3])
def test_small_tables(spark, rows):
    assert got(op.nearest(spark.createDataFrame(rows, SCHEMA), 20, "id % 5 = 0")) == brute(rows, 20, 5)


def test_copies_beyond_a_third_of_all_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(300)] + [(i, [float(i % 7), 1.0, float(i % 11)], 1) for i in range(300, 700)]
    assert got(op.nearest(spark.createDataFrame(rows, SCHEMA).repartition(5), 20, "id % 5 = 0", beam=100)) == brute(rows, 20, 5)


def test_every_node_is_reached():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(400, 8)) * 0.01 + 100 * r.normal(size=8) for _ in range(5)]).astype(np.float32)
    links, entries = op.build_graph(x, degree=4, beam=8)
    seen, front = set(entries.tolist()), entries.tolist()
    while front:
        front = [m for n in front for m in links[n].tolist() if m >= 0 and m not in seen and not seen.add(m)]
    assert len(seen) == len(x)


@pytest.mark.parametrize("seed", range(3))
def test_a_crowd_around_the_mean_is_no_trap(seed):
    """A third of all vectors lie close together around the mean; in any order the walk finds what is elsewhere."""
    r = np.random.default_rng(seed)
    v = r.normal(size=(2_400, 32))
    v[:800] = 0.02 * r.normal(size=(800, 32)) + v.mean(0) + 0.3
    v = (v / np.linalg.norm(v, axis=1, keepdims=True))[r.permutation(2_400)]
    x = op._scaled(v)
    links, entries = op.build_graph(np.column_stack([x, np.zeros(len(x), np.float32)]))
    q = v[::8]
    ids = op.beam_search(x, np.zeros(len(x), np.float32), links, entries, q.astype(np.float32), op.SEARCH_BEAM)[0]
    scores = np.where(ids >= 0, np.einsum("bcd,bd->bc", v[ids], q), -np.inf)
    top = np.take_along_axis(ids, np.argsort(-scores, axis=1, kind="stable")[:, :20], 1)
    best = np.argsort(-(q @ v.T), axis=1, kind="stable")[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(top.tolist(), best.tolist(), strict=True)]) >= 0.95


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall(spark, sf):
    at = f"/root/testdata/sf{sf}"
    rows = list(zip(*pq.read_table(f"{at}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict().values(), strict=True))
    want, made = {}, {}
    ids = np.array([i for i, v in rows if usable(v)])
    v = np.array([v for _, v in rows if usable(v)], dtype=np.float64)
    for q in np.flatnonzero(ids % 20 == 0):
        scores = v @ v[q]
        scores[q] = -np.inf
        want[int(ids[q])] = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
    for query, rank, vec, score in got(op.op11_neighbours(spark, at)):
        made.setdefault(query, {})[vec] = score
        assert len(made[query]) == rank
    by_id = dict(zip(ids.tolist(), v, strict=True))
    assert made.keys() == want.keys()
    assert all(len(m) == 20 and list(m.values()) == sorted(m.values(), reverse=True) for m in made.values())
    assert all(abs(s - by_id[q] @ by_id[i]) < 1e-12 for q, m in made.items() for i, s in m.items())
    assert np.mean([len(want[q] & made[q].keys()) / 20 for q in want]) >= 0.95
