import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from docloom.llm import substrings as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=20):
    texts = [(-(2**63) if i is None else i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in texts:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for (i, w), (key, _) in zip(texts, rows, strict=True):
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (i, s):
                gone.update(range(s, s + width))
        out.append((key, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    pool = [[r.choice(vocab) for _ in range(r.choice([15, 25, 60, 120]))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(4)):
            words += r.choice(pool)[r.randrange(8) :][: r.choice([20, 30, 200])] if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.randrange(80))]
        rows.append((r.randrange(10_000), r.choice([" ", "\n", " \t "]).join(words)))
    return rows + [(1, "a b " * 60), (2, "a b " * 40), (3, "x " * 300), (4, None), (5, ""), (6, "short text"), (7, " ".join(vocab[:20])), (8, " ".join(vocab[:20])), (8, " ".join(vocab[:20])), (None, " ".join(vocab[:25])), (9, "\x85 \x1c " * 30)]


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize(("seed", "shard"), [(1, 200_000), (2, 60)])
def test_brute_force(spark, monkeypatch, seed, shard):
    """With small shards anchors are cut by longer grams, down to whole windows."""
    monkeypatch.setattr(op, "SHARD_WORDS", shard)
    rows = corpus(seed)
    df = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, start string").repartition(3)
    assert got(op.remove_repeats(df)) == brute(rows)


def test_empty_table(spark):
    assert op.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block", [37, 50_000])
def test_anchors_cover_all_windows(monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK_WORDS", block)
    r = random.Random(3)
    words = [b"%d" % r.randrange(50) for _ in range(700)]
    anchor, start, n = op.anchors(words)
    assert start[0] == 0 and (start[1:] == start[:-1] + n[:-1]).all() and start[-1] + n[-1] == 700 - 19
    of = {}
    for a, s, k in zip(anchor, start, n, strict=True):
        for i in range(s, s + k):
            assert of.setdefault(tuple(words[i : i + 20]), a) == a


def test_fm_index_finds_all_places():
    r = np.random.default_rng(5)
    text = np.append(r.integers(1, 6, 500), 0)
    index = op.FMIndex(text, 4)
    for _ in range(200):
        p = r.integers(1, 6, r.integers(1, 8))
        low, high = np.array([0]), np.array([len(text)])
        for s in p[::-1]:
            low, high = index.back(np.array([s]), low, high)
        want = {i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()}
        assert set(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_sql_gives_the_same(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = c.sql(op.ORACLE_SQL["op8_substrings"]).fetchall()
    mine = [tuple(r) for r in op.op8_substrings(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(mine) == sorted(want) and any(r[2] for r in want)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(mine) == sorted((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute(docs))
