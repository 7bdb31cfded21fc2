"""Operator 4, WARC archives: written with revisit records, read back by boundary-chain verification.

A record is a header, an empty line, the payload and two line ends. Nothing marks where a record starts but its place:
the magic word may stand in a payload as well. So a reader that starts in the middle of a file only has candidates. Here
Spark's text reader splits the files at the magic word; every piece is a candidate, and with the length its header
states, it names where the next record should start. From the start of a file these links form one chain, and only what
is on it are records. The chain is followed by pointer jumping: each round joins the links with themselves, so that they
span twice as many records, and marks what the marked ones reach; the rounds grow with the logarithm of the records.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, forget, new_path

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: What the standard calls a revisit of an equal payload.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Rows that an archive file holds at most.
FILE_ROWS = 20_000
#: Rows of a digest or an offset up to which they are sent to every task, some 100 bytes each.
SMALL_ROWS = 100_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare base32 of the SHA-1: eight times four letters from five hexadecimal digits."""
    digest = F.sha1(payload)
    parts = [F.conv(F.substring(digest, i, 5), 16, 10).cast("long") for i in range(1, 41, 5)]
    return F.concat(*(F.substr(F.lit(_BASE32), (F.shiftright(p, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for p in parts for s in (15, 10, 5, 0)))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """(id, url, html, digest, record_type, refers_to): what is to be written for each page.

    Of pages with equal payloads (by SHA-256) of at least ``least`` bytes the one with the smallest id is the response and
    the others are revisits of it; null payloads are empty ones. Repeated ids stay separate rows, the first in no fixed order being
    the response. Payloads are not shuffled: digests are counted first, and those with copies are sent to all tasks up to
    SMALL_ROWS of them; beyond, adaptive execution splits the join where a digest is hot. An empty table gives no
    records, other columns are ignored, and a very long payload is one record like any other.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "same": F.sha2(F.col("html").cast("binary"), 256)})
    first = rows.where(F.octet_length("html") >= least).groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    first = cut(first.where("copies > 1").drop("copies"), "copies")
    if first.count() <= SMALL_ROWS:
        first = F.broadcast(first)
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.join(first, "same", "left").select(
        "id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to")
    )


def _line(prefix: str, value: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.coalesce(value.cast("string"), F.lit("")), F.lit(suffix))


def write(recs: DataFrame, path: str, compression: str = "gzip", date: str | None = None) -> None:
    """Write archives to ``path``: files of whole records, which Spark's text writer commits task by task.

    Compressed files have at most FILE_ROWS records and are read whole; uncompressed ones are read in splits.

    Revisits keep their own header and no payload. The text between two records is the writer's line end. ``date`` is the
    time of the records in ISO form, now if not given.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    full = F.octet_length("html")
    body = F.when(F.col("record_type") == "response", F.col("html")).otherwise("")
    lines = [
        F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), "record_type"), _line("WARC-Record-ID: <urn:page:", F.col("id"), ">"), _line("WARC-Target-URI: ", F.regexp_replace("url", r"[\r\n]", " ")),
        F.lit(f"WARC-Date: {date}"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"), _line("X-Payload-Length: ", full),
        F.when(F.col("record_type") == "revisit", _line(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:", F.col("refers_to"), ">")), _line("Content-Length: ", F.octet_length(body)),
    ]
    value = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body)
    recs.select(value.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", FILE_ROWS).option("compression", compression).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Candidates: what follows each magic word up to the next one, with what its header says.

    (file, block, row, bytes, piece, head, length, ...): ``bytes`` counts the piece and the magic word after it, ``head``
    the header with its empty line, ``length`` is the stated content length, null where there is no proper header.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("piece")
    )
    head = F.substring_index("piece", END, 1)
    proper = F.octet_length(head) < F.octet_length("piece")
    named = lambda name: F.nullif(F.regexp_extract(F.concat(F.lit("\r\n"), "top", F.lit("\r\n")), rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    raw = raw.withColumns({"bytes": F.octet_length("piece").cast("long") + len(MAGIC), "top": F.when(proper, head)})
    return raw.select(
        "file", "block", "row", "bytes", "piece", (F.octet_length("top") + len(END)).alias("head"), named("Content-Length").try_cast("long").alias("length"),
        named("WARC-Type").alias("type"), named("WARC-Record-ID").alias("record_id"), named("WARC-Target-URI").alias("uri"), named("WARC-Payload-Digest").alias("digest"),
        named("WARC-Refers-To").alias("refers_to"), named("X-Payload-Length").try_cast("long").alias("full_length"),
    )


def located(slim: DataFrame) -> DataFrame:
    """(file, row, at, next, whole) of each candidate: its offset, that of its successor, and if the piece has all of it.

    A split begins with the first magic word in it; offsets add up the bytes of the pieces before, first within the
    split, then of the splits before it. The first piece of a file stands before its first magic word and is left out.
    """
    in_block = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    blocks = slim.groupBy("file", "block").agg(F.sum("bytes").alias("all"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("base", F.sum("all").over(before) - F.col("all")).drop("all")
    placed = slim.withColumn("end", F.sum("bytes").over(in_block)).join(blocks, ["file", "block"])
    at = F.col("base") + F.col("end") - F.col("bytes") - len(MAGIC)
    rest = F.col("head") + F.col("length")
    placed = placed.select("file", "row", at.alias("at"), (at + len(MAGIC) + rest + len(END)).alias("next"), (F.col("bytes") - len(MAGIC) >= rest).alias("whole"))
    return placed.where("at >= 0")


def chain(links: DataFrame) -> DataFrame:
    """(file, at) of the records on each file's chain; ``links`` has (file, at, next) for every candidate."""
    known = links.select("file", "at").withColumnRenamed("at", "next")
    jumps = cut(links.where("next is not null").join(known, ["file", "next"], "left_semi"), "jumps")
    marked = cut(links.where("at = 0").select("file", "at"), "marked")
    size = marked.count()
    while True:
        reached = jumps.join(marked, ["file", "at"], "left_semi").select("file", F.col("next").alias("at"))
        grown = cut(marked.unionByName(reached).distinct(), "marked")
        forget(marked)
        marked, before, size = grown, size, grown.count()
        if size == before:
            return marked
        onward = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        further = cut(jumps.join(onward, ["file", "next"]).select("file", "at", F.col("then").alias("next")), "jumps")
        forget(jumps)
        jumps = further


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, type, record_id, uri, digest, refers_to, full_length, payload) of every record of the archives in ``path``.

    Payloads are bytes. A record whose header states no length cannot be passed over: its file ends there. Records stay where the scan has put them: only candidates off the chain are removed by a join,
    and only records whose payload holds the magic word are put together from their pieces. A folder without records gives
    no rows; a payload of any length is one value, in memory while its row is.
    """
    held = cut(pieces(spark, path), "pieces")
    links = cut(located(held.select("file", "block", "row", "bytes", "head", "length")), "links")
    real = chain(links)
    parts = links.join(real.withColumn("real", F.lit(True)), ["file", "at"], "left")
    odd = cut(parts.where("real is null or not whole"), "odd")
    fields = [F.expr("file"), *(F.col(c) for c in ("type", "record_id", "uri", "digest", "refers_to", "full_length"))]
    body = F.substring(F.col("piece").cast("binary"), F.col("head") + 1, F.col("length").cast("int"))
    out = held.where("head is not null and length is not null")
    if odd.isEmpty():
        return out.select(*fields, body.alias("payload"))
    plain = out.join(_few(odd.select("row")), "row", "left_anti").select(*fields, body.alias("payload"))
    # Each piece off the chain belongs to the last record before it; only those whose record is not whole matter.
    own = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    some = parts.join(_few(odd.select("file").distinct()), "file", "left_semi")
    some = some.withColumn("owner", F.last(F.when(F.col("real"), F.col("row")), ignorenulls=True).over(own))
    broken = odd.where("real and not whole").select(F.col("row").alias("owner"))
    some = cut(some.join(broken, "owner", "left_semi").select("row", "owner", "at"), "broken")
    found = held.join(_few(some), "row").groupBy("owner").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("all"), *(F.max(F.when(F.col("row") == F.col("owner"), F.col(c))).alias(c) for c in ("file", "head", "length", "type", "record_id", "uri", "digest", "refers_to", "full_length"))
    )
    found = found.withColumn("piece", F.array_join(F.col("all.piece"), MAGIC))
    return plain.unionByName(found.select(*fields, body.alias("payload")))


def _page(uri: str) -> Column:
    return F.regexp_extract(uri, "^<urn:page:(-?[0-9]+)", 1).try_cast("long")


def roundtrip(pages: DataFrame, path: str, compression: str = "gzip") -> DataFrame:
    """The rows of op4: every page as its record in the archives at ``path`` gives it."""
    write(records(pages), path, compression)
    response = F.col("type") == "response"
    return read(pages.sparkSession, path).select(
        _page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("full_length")).alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload"))).otherwise(F.substring_index("digest", ":", -1)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        _page("refers_to").alias("refers_to"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))


QUERIES = {"op4_warc": op4_warc}
_SQL_BASE32 = " || ".join(
    f"substr('{_BASE32}', CAST(('0x' || substr(h, {i}, 5))::BIGINT >> {s} & 31 AS BIGINT) + 1, 1)" for i in range(1, 41, 5) for s in (15, 10, 5, 0)
)
ORACLE_SQL = {
    "op4_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_SQL_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (html)"""
}
