import random

import duckdb
import numpy as np
import pytest

from docloom.llm import licenses as op

FULL = {name: max(texts, key=len) for name, texts in op.TEMPLATES.items()}


def brute(text, templates):
    own, out = op.words(text), set()
    s = op.shingles(own)
    for name, texts in templates.items():
        for t in texts:
            want = set(op.shingles(op.words(t)))
            few = op.words(t)
            if len(few) < op.SHINGLE:
                if any(own[i : i + len(few)] == few for i in range(len(own) - len(few) + 1)):
                    out.add(name)
                continue
            size = 1 << (len(op.words(t)) - op.SHINGLE).bit_length()
            for at in range(0, len(s), size):
                if len(want & set(s[at : at + 2 * size])) >= op.CONTAINMENT * len(want):
                    out.add(name)
    return out


def texts(seed):
    r = random.Random(seed)
    vocab = [f"wörd{i}" for i in range(200)]
    out = [None, "", "SPDX-License-Identifier: MIT", "# spdx-license-identifier:   ISC\nx", "SPDX License", "SPDX-License-Identifier: GPL-3.0-only etc", "Released under the MIT License", "released, under THE mit\nlicense!", "under the MIT License", "x" * 200_000]
    for name, t in FULL.items():
        noise = lambda: " ".join(r.choice(vocab) for _ in range(r.randrange(400)))
        out += [f"{noise()} {t} {noise()}", noise() + " " + t.upper().replace(" ", "  ") + ".", noise() + " " + " ".join(t.split()[: len(t.split()) // 2]) + " " + noise()]
        w = t.split()
        w[0] = "zzz"
        out.append(f"{noise()} {' '.join(w)} {name} {t} {noise()} {FULL[r.choice(list(FULL))]}")
    return out


def test_brute_force(spark):
    rows = [(i, t, "c") for i, t in enumerate(texts(1) + texts(2))] + [(2, "Released under the MIT License", "c"), (None, "x", None)]
    got = op.scan(spark.createDataFrame(rows, "doc_id long, text string, matches string").repartition(2)).collect()
    assert len(got) == len(rows)
    by = dict((a, b) for a, b, _ in rows)
    for r in got:
        assert {m.license for m in r.matches} == brute(by[r.doc_id], op.TEMPLATES)
        own = op.words(by[r.doc_id])
        for m in r.matches:
            assert 0 <= m["first"] < m["end"] <= len(own) and 0.8 <= m.containment <= 1


def test_collision_probability():
    r, missed, tries = np.random.default_rng(7), 0, 400
    index = op.Index({"t": [" ".join(f"a{i}" for i in range(13))]})  # 9 shingles in class 16: the hardest size
    for k in range(tries):
        own = [b"n%d" % x for x in r.integers(0, 10**9, 120)]
        own[40:53] = [b"a%d" % i for i in range(13)]
        missed += not any(index.verify(own, t, at) for _, t, at in index.retrieve([own]))
    assert missed == 0


def test_empty_table_and_templates(spark):
    assert op.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "Released under the MIT License")], "doc_id long, text string")
    assert op.scan(df, {}).first().matches == [] and op.scan(df, {"none": [" "]}).first().matches == []
    assert [(m.first, m.end) for m in op.scan(df, {"short": ["MIT"]}).first().matches] == [(3, 4)]


def test_sql_gives_the_same(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(c.sql(op.ORACLE_SQL["op3_licenses"]).fetchall())
    assert sorted(tuple(r) for r in op.op3_licenses(spark, "/root/testdata/sf0.01").collect()) == want and any(r[1] for r in want)


def test_templates_as_a_table(spark, monkeypatch):
    table = spark.createDataFrame([("A", "one two three"), ("B", "w1 w2 w3 w4 w5 w6 w7"), ("C", " "), (None, "x"), ("D", None)], "license string, text string")
    docs = spark.createDataFrame([(1, "so One, two three! w1 w2 w3 w4 w5 w6 w7"), (2, "one two"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: [(m.license, m.first, m.end) for m in r.matches] for r in op.scan(docs, table).collect()}
    assert got == {1: [("A", 1, 4), ("B", 4, 11)], 2: [], 3: []}
    monkeypatch.setattr(op, "TEMPLATE_CHARS", 5)
    with pytest.raises(ValueError, match="too many"):
        op.scan(docs, table)
