"""Odd pages and turns give what the SQL of their queries gives."""

import duckdb
import pytest

from docloom.operators.documents import parts_of
from docloom.plans.registry import ORACLE_SQL, QUERIES

PAGES = [
    (1, "u", "<title>a &amp; b&amp</title><p>c &amp d &lt; e &copy; f &quot;g&quot;"),
    (2, "u", "<title>say &quot;no&quot; &ampx</title><body>one&amp<br>two &middot; x&ampy</body>"),
    (3, "u", "<p>no title here, R&D, 1 & 2 &amp;amp;</p>"),
]
TURNS = [(1, 0, "user", "Yes.\nSame words."), (1, 1, "assistant", "No.\nSame words."), (2, 0, "user", "Hello\nyou  there"), (2, 1, "assistant", "Hello\nme"), (2, 2, "user", "Bye")]


@pytest.mark.parametrize("name", ["src6_page_text", "src6_titles", "doc17_web_chunks", "doc1_cleaned_text"])
def test_as_sql(spark, tmp_path, name):
    duck = duckdb.connect()
    for table, rows, schema in (("pages", PAGES, "page_id long, url string, html string"), ("conversations", TURNS, "conv_id long, turn int, role string, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = duck.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def test_batches_in_parts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(250))], ["a"])
    parts = list(parts_of(iter([batch])))
    assert [p.num_rows for p in parts] == [100, 100, 50] and pa.Table.from_batches(parts).column(0).to_pylist() == list(range(250))
