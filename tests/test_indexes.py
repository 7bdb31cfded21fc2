"""Searches by index give what scans give, and read less."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators.postings import Postings
from docloom.operators.retrieval import keyword_search, rank_chunks
from docloom.operators.vector_index import VectorIndex


def rows_read(df):
    """Rows that came out of the scans of a plan that has run, by folder."""
    df.collect()
    seen, out = [df._jdf.queryExecution().executedPlan()], {}
    while seen:
        node = seen.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            seen.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            seen.append(node.plan())
        elif name == "FileSourceScanExec":
            key = "postings" if "gram" in node.requiredSchema().simpleString() else "texts"
            out[key] = out.get(key, 0) + node.metrics().apply("numOutputRows").value()
        else:
            seen += [node.children().apply(i) for i in range(node.children().size())]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda Straße naïve".split()
    rows = [(i, f"src {words[i % 13]}", " ".join(words[(i * k + k) % 13] for k in range(1, 9)) + (" Rare%_Needle" if i % 997 == 5 else "")) for i in range(5_000)]
    return spark.createDataFrame([*rows, (9_000, None, None), (9_001, "", "ab"), (9_002, "x", "lower İ text needle")], "doc_id long, source string, text string")


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return Postings.build(docs, f"{tmp_path_factory.mktemp('p')}/postings", ["source", "text"])


@pytest.mark.parametrize("query", ["rare%_needle", "NEEDLE", "alpha beta", "src STRASSE", "straße", "naïve zeta", "ab", "x", "nowhere at all", "a b", "İ TEXT"])
def test_keyword(docs, index, query):
    want = [tuple(r) for r in keyword_search(docs, query, 50).select("doc_id", "matched_field").collect()]
    assert [tuple(r) for r in index.keyword(query, 50, ["source", "text"]).collect()] == want


@pytest.mark.parametrize("query", ["needle gamma", "rare", "no such thing here", "zeta İ"])
def test_ranking(docs, index, query):
    want = [tuple(r) for r in rank_chunks(docs.select("doc_id", "text"), query, 5).collect()]
    assert [tuple(r) for r in index.ranked(query, 5).collect()] == want


def test_search_reads_few_rows(docs, index):
    """Of 5,003 texts a rare phrase reads the shards that hold it, of the postings the row groups of its grams."""
    read = rows_read(index.keyword("rare%_needle", 50, ["source", "text"]))
    assert read["postings"] < index.postings.count() / 2 and read["texts"] < index.texts.count()
    assert rows_read(index.keyword("qqqqqq", 50, ["source", "text"])).get("texts", 0) == 0


def test_empty_index(spark, tmp_path):
    index = Postings.build(spark.createDataFrame([], "doc_id long, source string, text string").union(spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")), str(tmp_path / "postings"), ["text"])
    assert index.keyword("abc", 5, ["text"]).collect() == []


def cloud(n, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, 16))
    v = centres[r.integers(0, 30, n)] + 0.15 * r.normal(size=(n, 16))
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize(("n", "k", "cells"), [(3_000, 10, 40), (50, 80, 8), (7, 3, 64)])
def test_vectors_exactly(spark, tmp_path, n, k, cells):
    rows = cloud(n) + [(n + i, cloud(n)[0][1]) for i in range(5)] + [(n + 90, None), (n + 91, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = VectorIndex.build(df, str(tmp_path / "v"), cells)
    queries = df.where("vec_id % 37 = 0 or vec_id > 2990").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    got = {}
    for r in index.nearest(queries, k).orderBy("query", "place").collect():
        got.setdefault(r.query, []).append(r.vec_id)
    ids = np.array([i for i, v in rows if v and any(v)])
    unit = np.array([v for _, v in rows if v and any(v)])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q in (r.query for r in queries.collect()):
        if q in ids:
            s = unit @ unit[np.flatnonzero(ids == q)[0]]
            want = [int(ids[j]) for j in np.lexsort((ids, -np.round(s, 12))) if s[j] > 0][:k]
            assert got.get(q, []) == want
    assert not {n + 90, n + 91} & got.keys()


def test_share_of_vectors_visited(spark, tmp_path):
    """On clustered vectors a query looks at less than a third of them; the result is exact all the same (above)."""
    df = spark.createDataFrame(cloud(4_000), "vec_id long, embedding array<double>")
    index = VectorIndex.build(df, str(tmp_path / "v"), 60)
    own = df.where("vec_id < 20").select(F.col("vec_id").alias("query"), F.transform("embedding", lambda x: x / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, y: s + y * y))).alias("unit"))
    visited = index.visits(own, 10)[1].join(index.cells, "cell").agg(F.sum("n")).first()[0]
    assert visited < 20 * 4_000 / 3


def test_blocks_score_copies_alike(monkeypatch):
    """Copies tie wherever they stand in a block, so the smaller ids come first; scores are those of sums in order."""
    import pandas as pd

    from docloom.operators import vector_index

    monkeypatch.setattr(vector_index, "AT_ONCE", 2)
    v = np.random.default_rng(1).normal(size=(90, 33))
    v[[5, 40, 77, 88]] = v[60]
    vectors = pd.DataFrame({"vec_id": np.arange(90)[::-1], "embedding": list(v)})
    queries = pd.DataFrame({"query": [1, 2, 3], "unit": [v[60] / np.linalg.norm(v[60]), v[0], v[1]]})
    got = vector_index._block_best(queries, vectors, 3)
    assert got[got["query"] == 1]["vec_id"].tolist() == [1, 12, 29] and got[got["query"] == 1]["score"].nunique() == 1
    assert got.groupby("query").size().tolist() == [3, 3, 3]
