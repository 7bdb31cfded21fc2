import hashlib
import re

import duckdb
import pytest

from docloom.llm import middles as op

SMALL = "/root/testdata/sf0.001"


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def check(spark, rows, schema="doc_id long, text string"):
    made = op.fill_in_middle(spark.createDataFrame(rows, schema)).withColumn("back", op.restored())
    got = [tuple(r) for r in made.collect()]
    assert sorted((r[:6] for r in got), key=repr) == sorted((brute(*r[:2]) for r in rows), key=repr)
    assert sorted(r[6] for r in got) == sorted(r[1] or "" for r in rows)


ODD = ["", None, "a", "1", "ab cd", "\n\n", "é😀 x😀y", "a<P>b", "<S>", "<M>x", "<", "<S", "S>", "< P >", "<<<>>>", "x" * 9_000, "x y" * 5_000, "😀" * 5_000 + "abc" * 3_000]


def test_odd_texts(spark):
    """Every odd text under many ids, so that cuts fall at the start, the end and in between."""
    check(spark, [(60 * k + i, t) for k, t in enumerate(ODD) for i in range(20)])


def test_null_and_repeated_rows_and_ids(spark):
    check(spark, [(None, "one two"), (None, "one two"), (None, None), (7, "a b"), (7, "a b"), (7, "a c"), (8, "a b")] + [(9, "many of the same")] * 200)


def test_empty_table(spark):
    check(spark, [])


@pytest.mark.parametrize("extra", ["id", "key", "n", "form", "copies", "first", "doc", "piece", "chars", "output"])
def test_clashing_columns(spark, extra):
    check(spark, [(i, f"some words {i}, and more", "q") for i in range(5)], f"doc_id long, text string, {extra} string")


def test_very_long_text(spark):
    long = "lorem ipsum, " * 150_000
    check(spark, [(1, long), (2, long + "z"), (3, "k" * 1_500_000)])


def test_documents_by_sql_and_brute_force(spark):
    got = sorted(map(tuple, op.op13_fill_in_middle(spark, SMALL).collect()))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert got == sorted(c.sql(op.ORACLE_SQL["op13_fill_in_middle"]).fetchall())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = c.sql("SELECT doc_id, text FROM documents").fetchall()
    assert got == sorted((*brute(*r)[:5], sha(brute(*r)[5]), sha(r[1] or "")) for r in rows)


def test_texts_are_shuffled_once(spark):
    """The exchange of texts is made once and read by both sides; nothing else moves but what has the digest's partitioning."""
    made = op.op13_fill_in_middle(spark, SMALL)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.find("== Initial Plan ==")]
    assert final.count("ReusedExchange") >= 1
    assert final.count("ShuffleQueryStage") - final.count("ReusedExchange") == 1
