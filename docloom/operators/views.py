"""Scoped and optional filters, view joins, orders, name and date forms, transforms, signatures and padded rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.shaping import ordered_distinct
from docloom.plans.book import Book, table

BOOK = Book()


def optional_filters(rows: DataFrame, **wanted: object) -> DataFrame:
    """``rows`` where each column equals its value; a value of None asks for nothing."""
    return reduce(lambda df, item: df.where(F.col(item[0]) == F.lit(item[1])), ((c, v) for c, v in wanted.items() if v is not None), rows)


def file_name(name: Column, most: int = 60) -> Column:
    """A name that is safe in any file system: runs of other characters become one underscore."""
    return F.substring(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), 1, most)


def padded(cells: Column, width: int) -> Column:
    """Exactly ``width`` cells: short rows are filled with empty text, long ones cut."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(cells, i), F.lit("")))


def tag_list(tags: Column) -> Column:
    """Tags without leading number signs, blanks and repeats; the order stays."""
    return ordered_distinct(F.transform(tags, lambda x: F.regexp_replace(F.trim(x), "^#+", "")))


def phase_percent(done: Column, total: Column) -> Column:
    """45 to 75 by the share that is done, halves rounded to even; 45 without any work."""
    share = F.when(total > 0, done / total).otherwise(0.0)
    return F.least(F.lit(75), 45 + F.bround(share * 30).cast("int")).cast("long")


@BOOK.add("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def flt1_owner_scope(spark, sf_dir):
    return optional_filters(table(spark, sf_dir, "customer"), c_nationkey=3).select("c_custkey", "c_name")


@BOOK.add("SELECT vec_id, label FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL")
def flt9_not_null(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull() & F.col("label").isNotNull()).select("vec_id", "label")


@BOOK.add("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def flt13_optional(spark, sf_dir):
    return optional_filters(table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority=None).select("o_orderkey")


@BOOK.add("SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)")
def join2_labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "quality")


@BOOK.add("SELECT o_orderkey, coalesce(c_name, 'unknown') AS owner FROM orders j LEFT JOIN customer d ON j.o_custkey = d.c_custkey")
def join4_jobs_and_owners(spark, sf_dir):
    jobs, owners = table(spark, sf_dir, "orders").alias("j"), table(spark, sf_dir, "customer").alias("d")
    return jobs.join(owners, F.col("j.o_custkey") == F.col("d.c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("owner"))


@BOOK.add("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 AND o_orderstatus IN ('F', 'P')")
def join6_owner_and_type(spark, sf_dir):
    owners = optional_filters(table(spark, sf_dir, "customer"), c_nationkey=3).select("c_custkey")
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P")).join(owners, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey")


@BOOK.add("SELECT doc_id, unnest(['new', 'seen', 'kept']) AS tag FROM documents")
def join21_tags_for_all(spark, sf_dir):
    """Every document with every tag of a given list; an array instead of a cross join."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, ("new", "seen", "kept")))).alias("tag"))


@BOOK.add("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[Ll]icense')) AS BIGINT) AS n, substr(text, greatest(instr(text, 'icense') - 21, 1), 60) AS context FROM documents WHERE contains(text, 'icense')""")
def join23_references(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("icense")))
    at = F.greatest(F.instr("text", "icense") - 21, F.lit(1))
    return rows.select("doc_id", F.regexp_count("text", F.lit("[Ll]icense")).cast("long").alias("n"), F.substr("text", at, F.lit(60)).alias("context"))


@BOOK.add("""SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(len(string_split(coalesce(text, ''), ' '))) AS BIGINT) AS words, count(*) FILTER (n_chars < 200) AS short FROM documents GROUP BY lang""")
def agg14_acceptance(spark, sf_dir):
    words = F.size(F.split(F.coalesce("text", F.lit("")), " ", -1))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.sum(words).alias("words"), F.count_if(F.col("n_chars") < 200).alias("short"))


@BOOK.add("""SELECT conv_id, turn, CAST(coalesce(sum(coalesce(length(text), 0) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations""")
def win15_running_offset(spark, sf_dir):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).over(before)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(start, F.lit(0).cast("long")).alias("start"))


@BOOK.add("""SELECT o_orderkey FROM orders ORDER BY coalesce(nullif(o_orderstatus, 'P'), o_orderpriority), o_totalprice DESC, o_orderkey LIMIT 25""")
def srt2_name_then_total(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.coalesce(F.nullif("o_orderstatus", F.lit("P")), "o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey")


@BOOK.add("""SELECT p_partkey FROM part ORDER BY coalesce(nullif(p_size, 1), 0), CASE WHEN p_retailprice > 1500 THEN 0 ELSE 1 END, p_name, p_partkey LIMIT 30""")
def srt7_asset_order(spark, sf_dir):
    rank = F.when(F.col("p_retailprice") > 1500, 0).otherwise(1)
    return table(spark, sf_dir, "part").orderBy(F.coalesce(F.nullif("p_size", F.lit(1)), F.lit(0)), rank, "p_name", "p_partkey").limit(30).select("p_partkey")


@BOOK.add("SELECT p_partkey FROM part ORDER BY coalesce(nullif(p_size, 1), 999), p_partkey LIMIT 30")
def srt8_figure_order(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy(F.coalesce(F.nullif("p_size", F.lit(1)), F.lit(999)), "p_partkey").limit(30).select("p_partkey")


@BOOK.add("""SELECT p_partkey, substr(regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 60) AS file FROM part""")
def str24_file_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", file_name(F.concat("p_name", F.lit("/"), "p_type")).alias("file"))


@BOOK.add("""SELECT doc_id, substr(trim(regexp_replace(text, '[ \\n]+', ' ', 'g')), 1, 60) AS preview FROM documents""".replace("\\\\", "\\"))
def str25_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.trim(F.regexp_replace("text", "[ \\n]+", " ")), 1, 60).alias("preview"))


@BOOK.add("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso, CASE WHEN event_id % 5 <> 0 THEN CAST(year(ts) AS BIGINT) END AS year FROM events""")
def dt6_iso(spark, sf_dir):
    """Time stamps as ISO text and read back from it; what is no time stamp is null."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("iso"))
    given = F.when(F.col("event_id") % 5 == 0, "no date").otherwise(F.col("iso"))
    return rows.select("event_id", "iso", F.year(F.regexp_replace(given, "Z$", "").try_cast("timestamp")).cast("long").alias("year"))


@BOOK.add("SELECT p_partkey, round(0.5::DOUBLE * p_size + 1, 6) AS linear, round(pow(10::DOUBLE, 0.02::DOUBLE * p_size + 0.1::DOUBLE), 6) AS log FROM part")
def math4_transform(spark, sf_dir):
    px = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.lit(0.5) * px + 1, 6).alias("linear"), F.round(F.pow(F.lit(10.0), F.lit(0.02) * px + F.lit(0.1)), 6).alias("log"))


@BOOK.add("SELECT o_orderkey, CAST(least(75, 45 + CAST(round_even((o_orderkey % 11)::DOUBLE / 10 * 30, 0) AS BIGINT)) AS BIGINT) AS percent FROM orders")
def math9_phase(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", phase_percent((F.col("o_orderkey") % 11).cast("double"), F.lit(10)).alias("percent"))


@BOOK.add("SELECT p_partkey, substr(sha1(lower(trim(p_name)) || '|' || p_brand), 1, 16) AS signature FROM part")
def hsh2_signature(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.substring(F.sha1(F.concat_ws("|", F.lower(F.trim("p_name")), "p_brand")), 1, 16).alias("signature"))


@BOOK.add("SELECT p_partkey, ('0x' || substr(sha256(p_name), 1, 2))::BIGINT % 64 AS slot FROM part")
def hsh3_slot(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.conv(F.substring(F.sha2(F.col("p_name").cast("binary"), 256), 1, 2), 16, 10).cast("long") % 64).alias("slot"))


@BOOK.add("SELECT doc_id, CAST(to_json({'doc': doc_id, 'lang': nullif(lang, 'en')}) AS VARCHAR) AS record FROM documents")
def json4_record(spark, sf_dir):
    record = F.to_json(F.struct(F.col("doc_id").alias("doc"), F.nullif("lang", F.lit("en")).alias("lang")), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "documents").select("doc_id", record.alias("record"))


@BOOK.add("""SELECT p_partkey, coalesce(w[1], '') || '|' || coalesce(w[2], '') || '|' || coalesce(w[3], '') || '|' || coalesce(w[4], '') AS cells FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def arr2_padded(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(padded(F.split("p_name", " "), 4), "|").alias("cells"))


@BOOK.add("SELECT conv_id, array_to_string(list_slice(list(role ORDER BY turn), 1, 2), ',') AS first_two FROM conversations GROUP BY conv_id")
def arr10_first_of_group(spark, sf_dir):
    """The first two of each group, cut by rank before they are gathered."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", rank.alias("n")).where("n <= 2")
    part = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(part, lambda x: x["role"]), ",").alias("first_two"))


@BOOK.add("""SELECT p_partkey, array_to_string(list_filter(x, lambda v, i: list_position(list_transform(x, lambda u: lower(u)), lower(v)) = i), ',') AS tags FROM (SELECT p_partkey, string_split(p_type || ' ' || lower(p_type), ' ') AS x FROM part)""")
def dml8_tag_sync(spark, sf_dir):
    tags = F.transform(F.split(F.concat("p_type", F.lit(" "), F.lower("p_type")), " "), lambda x: F.concat(F.lit(" #"), x))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tag_list(tags), ",").alias("tags"))
