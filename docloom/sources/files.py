"""Readers and writers: text, coordinate CSV, JSON payloads, and exports. All go through Spark's own sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.functions.numbers import number_text
from docloom.plans.book import Book, table

BOOK = Book()
#: Columns of a coordinate file that describe a point and are neither x nor y.
META = ("series_name", "x_unit", "y_unit", "confidence", "source", "method", "note", "panel", "figure")
RECORDS = "struct<records:array<struct<property:string,value:string,unit:string,confidence:double>>>"
#: First bytes of a file and its kind.
MAGIC = [("255044462D", "pdf"), ("504B0304", "zip"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("1A45DFA3", "webm"), ("4D5A", "exe")]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of whole text files: UTF-8, else Latin-1; blank files and ones with a zero byte are errors (Spark leaves out files without any byte)."""
    return decoded(spark.read.format("binaryFile").load(path).select("path", "content"))


def decoded(raw: DataFrame) -> DataFrame:
    """(path, text, error) of files given as bytes (path, content)."""
    utf8 = F.expr("is_valid_utf8(cast(content AS string))")
    body = F.when(utf8, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    rows = raw.select("path", text.strip(body).alias("text"), F.hex("content").rlike("^(..)*00").alias("zero"))
    error = F.when(F.col("zero"), "binary").when(F.col("text") == "", "empty")
    return rows.select("path", F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error"))


def file_kind(content: Column) -> Column:
    """Kind of a file by its first bytes; text without control bytes is text, else unknown."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head == "", "empty")
    for magic, kind in MAGIC:
        out = out.when(head.startswith(magic), kind)
    out = out.when(head.rlike("^52494646.{8}57454250"), "webp").when(head.rlike("^52494646.{8}41564920"), "avi").when(head.rlike("^.{8}66747970"), "mp4")
    return out.when(F.hex(F.substring(content, 1, 512)).rlike("^(..)*(0[0-8B]|0E|0F|1[0-9A-F])"), "unknown").otherwise("text")


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, x_label, y_label, x_unit, y_unit, series): the first two columns that are no metadata, whatever their names."""
    return coordinates(spark.read.option("header", True).csv(path))


def coordinates(raw: DataFrame) -> DataFrame:
    """The same from rows of text whose columns are named as in the file."""
    axes = [c for c in raw.columns if c not in META][:2]
    if len(axes) < 2:
        raise ValueError("a coordinate file needs an x and a y column")
    own = lambda c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")
    label = lambda c: c.rpartition("(")[0].strip() if c.endswith(")") and "(" in c else c
    unit = lambda c: c.rpartition("(")[2][:-1].strip() if label(c) != c else ""
    x, y = axes
    rows = raw.select(
        own(x).try_cast("double").alias("x"), own(y).try_cast("double").alias("y"), F.lit(label(x)).alias("x_label"), F.lit(label(y)).alias("y_label"),
        F.coalesce(text.coalesce_blank(own("x_unit"), F.lit(unit(x))), F.lit("")).alias("x_unit"), F.coalesce(text.coalesce_blank(own("y_unit"), F.lit(unit(y))), F.lit("")).alias("y_unit"), own("series_name").alias("series"),
    )
    return rows.where("x is not null and y is not null")


def column_order(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(pos, name) of all columns: those of ``columns`` that hold anything but blanks, then the empty ones, then all others. One aggregate."""
    filled = {c: F.coalesce(F.bool_or(F.trim(F.col(c).cast("string")) != ""), F.lit(False)) for c in columns}
    named = [*columns, *(c for c in rows.columns if c not in columns)]
    places = F.array(*(F.struct((~F.col(c)).cast("int").alias("empty") if c in filled else F.lit(2).alias("empty"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(named)))
    return rows.agg(*(f.alias(c) for c, f in filled.items())).select(F.posexplode(F.transform(F.array_sort(places), lambda p: p["name"])).alias("pos", "name"))


def filled_first(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with their columns in the order of ``column_order``; only the names of columns come to the driver."""
    return rows.select(*(r["name"] for r in column_order(rows, columns).orderBy("pos").collect()))


def payload_records(rows: DataFrame, payload: str) -> DataFrame:
    """Records of model payloads as rows; a missing confidence is .5, payloads that are no JSON object give none."""
    r = F.from_json(payload, RECORDS)
    out = rows.withColumn("_r", F.explode(r["records"]))
    return out.select(*rows.columns, "_r.property", "_r.value", F.coalesce("_r.unit", F.lit("")).alias("unit"), F.coalesce("_r.confidence", F.lit(0.5)).alias("confidence"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header in every part; nulls are empty, numbers in short form, time stamps in ISO form."""
    kinds = dict(rows.dtypes)
    form = lambda c: number_text(F.col(c)) if kinds[c] == "double" else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kinds[c].startswith("timestamp") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows.select(*(form(c).alias(c) for c in rows.columns)).write.option("header", True).option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", False).json(path)


def markdown_report(rows: DataFrame, title: str, body: str, order: str) -> DataFrame:
    """One Markdown section a row, in order, as rows of text for Spark's text writer."""
    return rows.orderBy(order).select(F.concat(F.lit("## "), F.coalesce(title, F.lit("untitled")), F.lit("\n\n"), F.coalesce(body, F.lit("")), F.lit("\n")).alias("value"))


@BOOK.add("""SELECT doc_id, source AS collection, coalesce(lang, '') AS lang, coalesce(n_chars, 0) AS n_chars, substr(text, 1, 80) AS title FROM documents""")
def snk1_document_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("collection"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("n_chars", F.lit(0).cast("long")).alias("n_chars"), F.substring("text", 1, 80).alias("title"))


@BOOK.add("""SELECT event_id, 'k' AS property, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value, '' AS unit, 0.5::DOUBLE AS confidence FROM events""")
def src12_payload_records(spark, sf_dir):
    payload = F.concat(F.lit('{"records": [{"property": "k", "value": "'), F.get_json_object("props", "$.k"), F.lit('"}]}'))
    return payload_records(table(spark, sf_dir, "events").select("event_id", payload.alias("p")), "p").drop("p")


def markdown_member(names: DataFrame, by: str, name: str) -> DataFrame:
    """(by, name): of the files of a parser's result the one to read: full.md, else auto/full.md, else the least deep, then shortest, then first."""
    low = F.lower(name)
    rank = F.when(low.endswith("full.md"), 0).otherwise(1)
    deep = F.length(name) - F.length(F.replace(F.col(name), F.lit("/"), F.lit("")))
    first = F.when(rank == 0, F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.col("pos").cast("string").alias("d"))).otherwise(F.struct(F.lit(1).alias("a"), deep.alias("b"), F.length(name).alias("c"), F.col(name).alias("d")))
    return names.groupBy(by).agg(F.min_by(name, first).alias(name))


def listed_images(files: DataFrame, notes: DataFrame) -> DataFrame:
    """(ordinal, path, place, kind, caption): image files in order of their path with what the parser's list says of each.

    ``files``: path; ``notes``: img_path, pos, type, captions (array). A folder's list is small; it is numbered in one order.
    """
    own = files.where(F.lower("path").rlike(r"\.(png|jpe?g|webp|gif|bmp)$")).withColumn("ordinal", F.row_number().over(Window.orderBy("path")))
    name = F.concat(F.lit("images/"), F.substring_index("path", "/", -1))
    rows = own.join(notes, name == F.col("img_path"), "left")
    return rows.select("ordinal", "path", F.coalesce("pos", "ordinal").alias("place"), F.coalesce("type", F.lit("")).alias("kind"), F.coalesce(F.array_join("captions", " "), F.lit("")).alias("caption"))


@BOOK.add("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Größe ' || source WHEN 1 THEN 'Größe ' || source END AS text, CASE doc_id % 4 WHEN 2 THEN 'empty' WHEN 3 THEN 'binary' END AS error FROM documents""")
def src2_text_files(spark, sf_dir):
    """Bytes as text: UTF-8, else Latin-1; blank ones and ones with a zero byte are errors."""
    said = F.concat(F.lit(" Größe "), "source", F.lit("\n"))
    content = F.when(F.col("doc_id") % 4 == 0, F.encode(said, "UTF-8")).when(F.col("doc_id") % 4 == 1, F.encode(said, "ISO-8859-1")).when(F.col("doc_id") % 4 == 2, F.encode(F.lit(" \n"), "UTF-8")).otherwise(F.unhex(F.lit("4100")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), content.alias("content"))
    return decoded(rows).select(F.col("path").alias("doc_id"), "text", "error")


@BOOK.add("""SELECT doc_id, ['pdf','zip','png','jpeg','webm','exe','webp','avi','mp4','text','unknown','empty'][doc_id % 12 + 1] AS kind FROM documents""")
def src11_file_kinds(spark, sf_dir):
    """Kinds of files by their first bytes."""
    heads = ("255044462D312E", "504B030414", "89504E470D0A1A0A00", "FFD8FFE0", "1A45DFA3", "4D5A90", "524946460000000057454250", "524946460000000041564920", "00000018667479706D703432", "68656C6C6F0A", "68656C00", "")
    content = F.unhex(F.element_at(F.array(*(F.lit(h) for h in heads)), (F.col("doc_id") % 12 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("c")).select("doc_id", file_kind(F.col("c")).alias("kind"))


@BOOK.add("""SELECT p_partkey % 30 AS result, CASE WHEN p_partkey % 30 % 3 = 0 THEN 'out/auto/FULL.md' WHEN p_partkey % 30 % 3 = 1 THEN 'a.md' ELSE 'b/c.md' END AS name FROM part GROUP BY 1, 2""")
def src5_markdown_member(spark, sf_dir):
    files = F.when(F.col("r") % 3 == 0, F.array(F.lit("a.md"), F.lit("out/auto/FULL.md"), F.lit("z/full.md"))).when(F.col("r") % 3 == 1, F.array(F.lit("x/y.md"), F.lit("bb.md"), F.lit("a.md"))).otherwise(F.array(F.lit("x/y/z.md"), F.lit("b/d.md"), F.lit("b/c.md")))
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 30).alias("r")).distinct().select(F.col("r").alias("result"), F.posexplode(files).alias("pos", "name"))
    return markdown_member(rows, "result", "name")


@BOOK.add("""SELECT p_size::DOUBLE AS x, p_retailprice AS y, 'Time' AS x_label, 'Stress' AS y_label, CASE WHEN p_size % 2 = 0 THEN 'min' ELSE 's' END AS x_unit, 'Pa' AS y_unit, p_brand AS series FROM part WHERE p_size % 7 <> 0""")
def src7_coordinates(spark, sf_dir):
    """Coordinate rows under headers that name the axes; a row's own unit goes before the header's, rows without numbers are dropped."""
    x = F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("series_name"), x.alias("Time (s)"), F.when(F.col("p_size") % 2 == 0, "min").otherwise("").alias("x_unit"), F.col("p_retailprice").cast("string").alias("Stress (Pa)"))
    return coordinates(rows)


@BOOK.add("""WITH f AS (SELECT count(*) FILTER (trim(p_name) <> '') > 0 AS a, count(*) FILTER (p_size > 100) > 0 AS b, false AS c, count(*) FILTER (trim(p_type) <> '') > 0 AS d FROM part),
l AS (SELECT unnest([{'e': CASE WHEN a THEN 0 ELSE 1 END, 'i': 0, 'n': 'p_name'}, {'e': CASE WHEN b THEN 0 ELSE 1 END, 'i': 1, 'n': 'huge'}, {'e': CASE WHEN c THEN 0 ELSE 1 END, 'i': 2, 'n': 'blank'}, {'e': CASE WHEN d THEN 0 ELSE 1 END, 'i': 3, 'n': 'p_type'}, {'e': 2, 'i': 4, 'n': 'p_partkey'}]) AS x FROM f)
SELECT CAST(row_number() OVER (ORDER BY x.e, x.i) - 1 AS INTEGER) AS pos, x.n AS name FROM l""")
def src8_filled_first(spark, sf_dir):
    """The order of columns: those of the context that hold anything in any row, then the empty ones, then all others."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 100, F.col("p_brand")).alias("huge"), "p_name", F.lit("  ").alias("blank"), "p_type")
    return column_order(rows, ["p_name", "huge", "blank", "p_type"])


@BOOK.add("""WITH f AS (SELECT 'dir/i' || lpad(p_partkey::VARCHAR, 9, '0') || CASE WHEN p_size % 5 = 0 THEN '.txt' ELSE '.PNG' END AS path, p_partkey, p_size FROM part), o AS (SELECT *, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS ordinal FROM f WHERE p_size % 5 <> 0)
SELECT ordinal, path, CASE WHEN p_size % 2 = 0 THEN p_size ELSE ordinal END AS place, CASE WHEN p_size % 2 = 0 THEN 'chart' ELSE '' END AS kind, CASE WHEN p_size % 2 = 0 THEN 'Growth of ' || p_partkey ELSE '' END AS caption FROM o""")
def src9_listed_images(spark, sf_dir):
    name = F.concat(F.lit("i"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.when(F.col("p_size") % 5 == 0, ".txt").otherwise(".PNG"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", name.alias("n"))
    notes = rows.where("p_size % 2 = 0").select(F.concat(F.lit("images/"), "n").alias("img_path"), F.col("p_size").alias("pos"), F.lit("chart").alias("type"), F.array(F.lit("Growth of"), F.col("p_partkey").cast("string")).alias("captions"))
    return listed_images(rows.select(F.concat(F.lit("dir/"), "n").alias("path")), notes)
