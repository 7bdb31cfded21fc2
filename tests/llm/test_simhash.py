import random
import re

import numpy as np
import pytest
import xxhash

from docloom.llm import simhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(prints):
    """Component of each print by brute force."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def clustered(n, seed):
    r = random.Random(seed)
    out = [0, 1, 2**64 - 1, 2**63]
    while len(out) < n:
        x = r.getrandbits(64) if r.random() < 0.2 else r.choice(out)
        for _ in range(r.choice([0, 1, 2, 3, 4, 7])):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One two", "a b c", "A\x0bb\x1cc D é É", "z " * 5000, "\x85 \xa0 q"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize(("seed", "frontier"), [(1, 10**6), (2, 7), (3, 100)])
def test_trie_walk(seed, frontier):
    prints = sorted(set(clustered(250, seed)))
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in simhash.trie_links(np.array(prints, dtype=np.uint64), frontier=frontier):
        assert (prints[i] ^ prints[j]).bit_count() <= 3
        x, y = find(i), find(j)
        assert x != y
        root[max(x, y)] = min(x, y)
    want = classes(prints)
    assert len({(find(i), want[i]) for i in range(len(prints))}) == len(set(want)) == len({find(i) for i in range(len(prints))})


@pytest.mark.parametrize("group_rows", [512, 8])
def test_links_over_keys(spark, group_rows):
    prints = sorted(set(clustered(300, 5)))
    df = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp long")
    from docloom.llm.shared import components

    got = {r.node % 2**64: r.component for r in components(simhash.links(df, group_rows)).collect()}
    want = dict(zip(prints, classes(prints), strict=True))
    pairs = {(want[p], got.get(p, p)) for p in prints}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = sorted(docs)
    prints = [slow_fingerprint(docs[i]) for i in ids]
    want = {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, classes(prints), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_odd_rows(spark):
    rows = [(5, None, "x"), (3, "", "x"), (9, "a b c d e", "x"), (9, "a b c d e", "x"), (None, "a b c d e", "x"), (None, "q r s t u v", "x")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 9), (9, 9), (None, 9), (None, None)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_of_null_and_repeated_ids(spark):
    r = random.Random(7)
    a, b, c, d, e, f = (" ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=200)) for _ in range(6))
    rows = [(0, a), (1, a), (1, b), (2, b), (None, b), (None, c), (None, c), (None, d), (None, None), (7, e), (7, f), (7, f), (8, e), (9, f)]
    group = classes([slow_fingerprint(t) for _, t in rows])
    want = {g: min((i is None, i or 0, t or "") for (i, t), own in zip(rows, group, strict=True) if own == g) for g in group}
    assert len(want) == 7
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.text or "") for x in got) == sorted(want.values())
    named = spark.createDataFrame([(None if i is None else f"n{i}", t) for i, t in rows], "doc_id string, text string")
    assert simhash.keep_one(named).count() == 7
    assert simhash.keep_one(named.limit(0)).count() == 0


def test_keep_one_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c", "p", 4, 5, "x"), (2, "a b c", "q", 4, 5, "y")], "doc_id long, text string, _digest string, n int, row int, id string")
    assert [tuple(r) for r in simhash.keep_one(df).collect()] == [(1, "a b c", "p", 4, 5, "x")]


def test_large_keys_are_taken_apart_to_the_end(spark):
    base = 0x123456789ABCDEF0
    prints = sorted({base ^ (x << 20) for x in range(1 << 10)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    sizes = simhash.deal(df, 64).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert sizes <= 64
    from docloom.llm.shared import components

    assert {r.component for r in components(simhash.links(df, 64)).collect()} == {prints[0]}
