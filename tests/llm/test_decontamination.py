import hashlib
import re

import duckdb
import pytest

from docloom.llm import decontamination as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1)):
            if w:
                wins.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    lengths, out = {len(x) for x in wins}, []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


P = [f"word{i}" for i in range(40)]
ITEMS = [(1, " ".join(P[:12])), (22, " ".join(P[2:13])), (3, "Tiny Éx item"), (4, None), (5, "..."), (6, "a a a a a a a a a a a"), (7, " ".join(P[:12])), (8, "never seen words at all in any of these texts really")]
DOCS = [
    (1, "x " + " ".join(P[:12]) + " y"), (2, " ".join(P[:9])), (3, " ".join(P[:10])), (4, " ".join(P[1:11]).upper()), (5, "tiny-éx item tiny ÉX item"), (6, "tiny Éx,ITEM"), (7, None), (8, ""),
    (9, " ".join(["a"] * 25)), (9, " ".join(["a"] * 25)), (9, "other text"), (None, " ".join(P)), (10, " ".join(P[3:13]) + " z " + " ".join(P[:11])), (11, " ".join(P * 300)),
]


@pytest.mark.parametrize(("words", "windows"), [(op.WORD_BYTES, op.SMALL_BYTES), (0, 0), (0, op.SMALL_BYTES), (op.WORD_BYTES, 0)])
def test_brute_force(spark, monkeypatch, words, windows):
    monkeypatch.setattr(op, "WORD_BYTES", words)
    monkeypatch.setattr(op, "SMALL_BYTES", windows)
    docs = spark.createDataFrame([(a, b, "c") for a, b in DOCS], "doc_id long, text string, win string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(op.contamination(docs, items)) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS[:3], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(op.contamination(docs, items.limit(0))) == brute(DOCS[:3], [])
    assert op.contamination(docs.limit(0), items).count() == 0


def test_sql_gives_the_same(spark):
    at = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    want = c.sql(op.ORACLE_SQL["op10_decontamination"]).fetchall()
    mine = op.op10_decontamination(spark, at)
    assert mine.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert got(mine) == sorted(want, key=str) and any(r[5] for r in want)


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(a, b, "c", "d", 1, 2) for a, b in DOCS], "doc_id long, text string, _id string, bad string, row int, digest int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = op.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(not r[5] for r in brute(DOCS, ITEMS))
