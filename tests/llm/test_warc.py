import base64
import hashlib

import duckdb
import pytest

from docloom.llm import warc


def want(rows):
    first = {}
    for page, _, html in rows:
        first.setdefault(html or "", page)
        first[html or ""] = min(first[html or ""], page)
    out = []
    for page, _, html in rows:
        data, other = (html or "").encode(), first[html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "response" if other == page else "revisit", None if other == page else other))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [(i, f"http://x/{i}", f"<html>{'p' * (i * 7 % 400)} é {i}</html>") for i in range(400)] + [
    (400, None, None), (401, "u\r\nWARC-Type: evil", ""), (402, "u", FAKE), (403, "u", "x" + FAKE * 50 + "tail"), (404, "u", "WARC/1.0\r\n"), (405, "u", "WARC/1.0\r\nWARC/1.0\r\n\r\n\r\n" * 3), (406, "u", FAKE),
    (407, "u", "\r\n\r\n"), (408, "u", "日本語" * 3000), (409, "u", "WARC/1.0"), (410, "u", "\nContent-Length: 5\r\n\r\n" + FAKE[:60]),
] + [(500 + i, "u", "same") for i in range(200)]


@pytest.mark.parametrize(("compression", "split"), [("gzip", "64m"), ("none", "3k"), ("none", "64m")])
def test_round_trip(spark, tmp_path, compression, split):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = spark.createDataFrame([(*r, 1) for r in PAGES], "page_id long, url string, html string, digest int").repartition(3)
        assert got(warc.roundtrip(df, f"file://{tmp_path}/w", compression)) == want(PAGES)
        payloads = {r.record_id: bytes(r.payload).decode() for r in warc.read(spark, f"file://{tmp_path}/w").collect() if r.type == "response"}
        assert payloads["<urn:page:403>"] == PAGES[403][2] and payloads["<urn:page:405>"] == PAGES[405][2]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_many_rows_beyond_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL_ROWS", 0)
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert got(warc.roundtrip(df, f"file://{tmp_path}/w")) == want(PAGES)


def test_files_are_warc(spark, tmp_path):
    warc.write(warc.records(spark.createDataFrame([(1, "http://a/", "<p>é</p>")], "page_id long, url string, html string")), f"file://{tmp_path}/w", "none")
    data = b"".join(f.read_bytes() for f in (tmp_path / "w").glob("*.txt"))
    head, _, rest = data.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.0\r\nWARC-Type: response\r\n") and b"Content-Length: 9" in head and rest == "<p>é</p>\r\n\r\n".encode()


def test_empty_table_and_repeated_ids(spark, tmp_path):
    assert warc.roundtrip(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/a").count() == 0
    twice = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "b")], "page_id long, url string, html string")
    assert warc.roundtrip(twice, f"file://{tmp_path}/b").count() == 3


def test_sql_gives_the_same(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    rows = c.sql("SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM (" + warc.ORACLE_SQL["op4_warc"] + ")").fetchall()
    assert got(warc.op4_warc(spark, "/root/testdata/sf0.001")) == sorted(rows)
