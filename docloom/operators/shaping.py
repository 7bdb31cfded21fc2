"""Projections and nested values: labels, decision tables, dates, geometry, arrays and JSON."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import numbers, text
from docloom.plans.book import Book, table

BOOK = Book()


def first_rule(rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first rule (SQL condition) that holds."""
    out = F.when(F.expr(rules[0][1]), rules[0][0])
    return reduce(lambda c, rule: c.when(F.expr(rule[1]), rule[0]), rules[1:], out).otherwise(other)


def ordered_distinct(items: Column) -> Column:
    """Trimmed items without blanks, of those alike but for case the first; the order stays."""
    clean = F.filter(F.transform(items, F.trim), lambda x: x != "")
    low = F.transform(clean, F.lower)
    return F.filter(clean, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def table_markdown(headers: Column, rows: Column) -> Column:
    """A Markdown table; pipes in cells are escaped, short rows padded."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda h: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, lambda r: line(F.transform(headers, lambda h, i: F.get(r, i))))), "\n")


def captions_to_boxes(captions: DataFrame, boxes: DataFrame, gap: float = 0.34, margin: float = 10.0) -> DataFrame:
    """The region of each caption: the union of the boxes above it on its page that are near and share columns with it.

    captions: doc, page, label, x0, y0, x1, y1, width, height; boxes: doc, page, x0, y0, x1, y1. An equi join on the page
    with the range as its residual, in which boxes and captions of one place are one row each; a caption without boxes gets
    the strip above it.
    """
    b = boxes.select("doc", "page", *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1"))).distinct()
    # Captions of a page with one label have one region, wherever they stand.
    named = ["doc", "page", "label"]
    place = ["x0", "y0", "x1", "y1", "width", "height"]
    near = (F.col("b_y1") <= F.col("y0") + 2) & (F.col("y0") - F.col("b_y1") <= F.col("height") * gap) & (F.least("x1", "b_x1") > F.greatest("x0", "b_x0"))
    ends = {"u0": F.min, "v0": F.min, "u1": F.max, "v1": F.max}
    found = captions.select("doc", "page", *place).distinct().join(b, ["doc", "page"]).where(near).groupBy("doc", "page", *place).agg(*(how(f"b_{c}").alias(e) for (e, how), c in zip(ends.items(), ("x0", "y0", "x1", "y1"), strict=True)))
    found = captions.join(found, ["doc", "page", *place]).groupBy(*named).agg(*(how(e).alias(e) for e, how in ends.items()))
    rows = captions.join(found, ["doc", "page", "label"], "left")
    inside = lambda x, high: F.greatest(F.lit(0.0), F.least(high, x))
    return rows.select(
        "doc", "page", "label",
        inside(F.coalesce(F.col("u0") - margin, F.col("x0")), F.col("width")).alias("x0"), inside(F.coalesce(F.col("v0") - margin, F.col("y0") - F.col("height") * gap), F.col("height")).alias("y0"),
        inside(F.coalesce(F.col("u1") + margin, F.col("x1")), F.col("width")).alias("x1"), inside(F.coalesce(F.col("v1") + margin, F.col("y0")), F.col("height")).alias("y1"), F.col("u0").isNull().alias("is_default"),
    )


def words_to_lines(words: DataFrame) -> DataFrame:
    """Lines with their boxes from words (page, block, line, x0, y0, x1, y1, word)."""
    rows = words.groupBy("page", "block", "line", F.floor(F.col("y0") / 5).alias("band")).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_sort(F.collect_list(F.struct("x0", "word"))).alias("w")
    )
    return rows.select("page", "block", "line", "x0", "y0", "x1", "y1", F.array_join(F.transform("w", lambda w: w["word"]), " ").alias("text"))


@BOOK.add("""SELECT d.doc_id, coalesce(nullif(nullif(lang, 'en'), ''), source, 'none') AS name, CASE WHEN toxic = 1 THEN 'review' WHEN quality = 1 THEN 'ready' WHEN quality = 0 THEN 'parsed' ELSE 'waiting' END AS progress FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def prj2_task_view(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    progress = first_rule([("review", "toxic = 1"), ("ready", "quality = 1"), ("parsed", "quality = 0")], "waiting")
    return rows.select("doc_id", text.coalesce_blank(F.nullif("lang", F.lit("en")), F.col("source"), F.lit("none")).alias("name"), progress.alias("progress"))


@BOOK.add("""SELECT p_partkey, coalesce(nullif(substr(regexp_replace(trim(p_type), '\\s+', '_', 'g'), 1, 80), ''), 'unknown') AS field, CASE WHEN p_size > 40 THEN 'table' WHEN p_size > 20 THEN 'figure' ELSE 'text' END AS kind FROM part""".replace("\\\\", "\\"))
def prj8_field_name(spark, sf_dir):
    name = F.substring(F.regexp_replace(text.strip(F.col("p_type")), r"\s+", "_"), 1, 80)
    return table(spark, sf_dir, "part").select("p_partkey", text.coalesce_blank(name, F.lit("unknown")).alias("field"), first_rule([("table", "p_size > 40"), ("figure", "p_size > 20")], "text").alias("kind"))


@BOOK.add("""SELECT p_partkey, regexp_matches(lower(p_type), 'steel|brass') AND NOT regexp_matches(lower(p_name), 'red') AS valid FROM part""")
def flt16_valid_results(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (text.any_marker(F.col("p_type"), ["steel", "brass"]) & ~text.any_marker(F.col("p_name"), ["red"])).alias("valid"))


@BOOK.add("""SELECT count(*) AS hits, coalesce(max(n_chars), 0) < 300 OR count(*) < 3 AS search_web FROM documents WHERE contains(lower(text), 'apache')""")
def flt23_web_trigger(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("apache")))
    return hits.agg(F.count("*").alias("hits"), ((F.coalesce(F.max("n_chars"), F.lit(0)) < 300) | (F.count("*") < 3)).alias("search_web"))


@BOOK.add("""SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host, regexp_matches(url, '^https?://') AND NOT regexp_matches(regexp_extract(url, '^https?://([^/:]+)', 1), '^(localhost|127\\.|10\\.|192\\.168\\.|169\\.254\\.)') AS safe FROM pages""".replace("\\\\", "\\"))
def flt24_url_safety(spark, sf_dir):
    """Only web addresses, none on this machine or in a private range; numeric addresses are compared as numbers."""
    host = F.regexp_extract("url", "^https?://([^/:]+)", 1)
    octets = F.transform(F.split(host, r"\."), lambda x: x.try_cast("long"))
    number = F.when(host.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x))
    private = [(10 << 24, 8), (127 << 24, 8), (169 << 24 | 254 << 16, 16), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16), (100 << 24 | 64 << 16, 10), (0, 8)]
    inner = reduce(lambda a, b: a | b, (number.between(low, low + (1 << (32 - bits)) - 1) for low, bits in private))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), (F.col("url").rlike("^https?://") & (host != "localhost") & ~F.coalesce(inner, F.lit(False))).alias("safe"))


@BOOK.add("""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, coalesce(p.p_name, s.s_name, 'none') AS bound FROM lineitem l LEFT JOIN part p ON l_partkey = p_partkey AND p_size > 30 LEFT JOIN supplier s ON l_suppkey = s_suppkey AND s_acctbal > 0""")
def join17_fallback_binding(spark, sf_dir):
    parts, supp = table(spark, sf_dir, "part").where("p_size > 30").select("p_partkey", "p_name"), table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name")
    rows = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").join(supp, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("p_name", "s_name", F.lit("none")).alias("bound"))


@BOOK.add("""WITH c AS (SELECT p_partkey AS label, p_partkey % 20 AS doc, p_partkey % 3 AS page, (p_size * 7 % 300)::DOUBLE AS x0, (300 + p_size * 11 % 400)::DOUBLE AS y0 FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT p_partkey % 20 AS doc, p_partkey % 3 AS page, (p_size * 13 % 400)::DOUBLE AS x0, (p_size * 17 % 600)::DOUBLE AS y0 FROM part WHERE p_partkey % 2 = 1 OR p_partkey % 4 = 0),
f AS (SELECT c.label, min(b.x0) AS u0, max(b.y0) + 60 AS v1 FROM c JOIN b USING (doc, page) WHERE b.y0 + 60 <= c.y0 + 2 AND c.y0 - (b.y0 + 60) <= 800 * 0.34::DOUBLE AND least(c.x0 + 200, b.x0 + 90) > greatest(c.x0, b.x0) GROUP BY c.label)
SELECT label, round(greatest(0, least(600.0::DOUBLE, coalesce(u0 - 10, x0))), 4) AS x0, round(greatest(0, least(800.0::DOUBLE, coalesce(v1 + 10, y0))), 4) AS y1, u0 IS NULL AS is_default FROM c LEFT JOIN f USING (label)""")
def join24_caption_regions(spark, sf_dir):
    part, num = table(spark, sf_dir, "part"), lambda e: F.expr(f"cast({e} as double)")
    place = [F.expr("p_partkey % 20").alias("doc"), F.expr("p_partkey % 3").alias("page")]
    caps = part.where("p_partkey % 2 = 0").select(*place, F.col("p_partkey").alias("label"), num("p_size * 7 % 300").alias("x0"), num("300 + p_size * 11 % 400").alias("y0"))
    caps = caps.select("*", (F.col("x0") + 200).alias("x1"), (F.col("y0") + 20).alias("y1"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    box = part.where("p_partkey % 2 = 1 or p_partkey % 4 = 0").select(*place, num("p_size * 13 % 400").alias("x0"), num("p_size * 17 % 600").alias("y0"))
    box = box.select("*", (F.col("x0") + 90).alias("x1"), (F.col("y0") + 60).alias("y1"))
    return captions_to_boxes(caps, box).select("label", F.round("x0", 4).alias("x0"), F.round("y1", 4).alias("y1"), "is_default")


@BOOK.add("SELECT o_orderkey FROM orders ORDER BY o_orderpriority ASC NULLS LAST, o_totalprice ASC NULLS LAST, o_orderkey LIMIT 30")
def srt3_nulls_last(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.asc_nulls_last("o_orderpriority"), F.asc_nulls_last("o_totalprice"), "o_orderkey").limit(30).select("o_orderkey")


@BOOK.add("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def srt10_event_page(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).offset(40).limit(20).select("event_id")


@BOOK.add("WITH w AS (SELECT unnest([5,3,9,1]::BIGINT[]) AS doc_id, unnest([0,1,2,3]) AS pos) SELECT pos, doc_id, source FROM w JOIN documents USING (doc_id)")
def srt11_requested_order(spark, sf_dir):
    wanted = spark.range(1).select(F.posexplode(F.array(*(F.lit(i).cast("long") for i in (5, 3, 9, 1)))).alias("pos", "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(F.broadcast(wanted), "doc_id").select("pos", "doc_id", "source")


@BOOK.add("""SELECT p_partkey, array_to_string(list_filter(x, lambda v, i: list_position(list_transform(x, lambda u: lower(u)), lower(v)) = i), '|') AS tags FROM (SELECT p_partkey, string_split(p_type || ' ' || lower(p_type), ' ') AS x FROM part)""")
def set1_ordered_distinct(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(ordered_distinct(F.split(F.concat("p_type", F.lit(" "), F.lower("p_type")), " ")), "|").alias("tags"))


@BOOK.add("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def set4_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_anti")


@BOOK.add("SELECT l_partkey, l_shipdate, l_returnflag, min(l_extendedprice) AS price FROM lineitem GROUP BY l_partkey, l_shipdate, l_returnflag")
def set6_asset_dedup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_shipdate", "l_returnflag").agg(F.min("l_extendedprice").alias("price"))


@BOOK.add("""WITH k AS (SELECT *, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS crops, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS tables FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber FROM k WHERE (crops = 1 AND l_returnflag = 'R') OR (crops = 0 AND tables = 1 AND l_returnflag = 'A') OR (crops = 0 AND tables = 0)""")
def set7_display_selection(spark, sf_dir):
    """Of each document the best kind of visual that it has."""
    rows = table(spark, sf_dir, "lineitem").withColumn("kind", F.expr("case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end"))
    best = F.min("kind").over(Window.partitionBy("l_orderkey"))
    return rows.withColumn("best", best).where("kind = best").select("l_orderkey", "l_partkey", "l_linenumber")


@BOOK.add("""SELECT o_orderkey, CAST(o_orderdate + INTERVAL 90 SECOND AS TIMESTAMP) AS next_run, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shown, o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 300 DAY AS stale FROM orders""")
def dt5_schedule(spark, sf_dir):
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("now"))
    rows = table(spark, sf_dir, "orders").crossJoin(F.broadcast(last))
    return rows.select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 90 SECONDS")).alias("next_run"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("shown"), (F.col("o_orderdate") < F.col("now") - F.expr("INTERVAL 300 DAYS")).alias("stale"))


@BOOK.add("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, round((least(a.s_acctbal + 500, b.s_acctbal + 800) - greatest(a.s_acctbal, b.s_acctbal)) / (greatest(a.s_acctbal + 500, b.s_acctbal + 800) - least(a.s_acctbal, b.s_acctbal)), 6) AS overlap FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def math6_range_overlap(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), "s_nationkey", F.col("s_acctbal").alias("x"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"), "s_nationkey", F.col("s_acctbal").alias("y"))
    # Pairs of a nation are dealt out by the second supplier, so that few nations keep all tasks busy; the number of partitions is stated, as the tables are small and their pairs are not.
    shares = 32
    a = a.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    b = b.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(shares)).cast("int"))
    a, b = (side.repartition(200, "s_nationkey", "share") for side in (a, b))
    rows = a.join(b, ["s_nationkey", "share"]).where("a < b")
    return rows.select("a", "b", F.round(numbers.overlap_ratio(F.col("x"), F.col("x") + 500, F.col("y"), F.col("y") + 800), 6).alias("overlap"))


@BOOK.add("""SELECT p_partkey, round(2 * sqrt(p_retailprice / pi()), 4) AS diameter, round(least(1, 4 * pi() * p_retailprice / (p_size * 4.0::DOUBLE + 100) ** 2), 4) AS circularity, round(greatest(0, 0.95::DOUBLE - 0.15::DOUBLE * (p_size % 4) - 0.05::DOUBLE * (p_size % 3)), 4) AS score FROM part""")
def math16_shape(spark, sf_dir):
    area, around = F.col("p_retailprice"), F.col("p_size") * 4.0 + 100
    score = F.greatest(F.lit(0.0), F.lit(0.95) - F.lit(0.15) * (F.col("p_size") % 4) - F.lit(0.05) * (F.col("p_size") % 3))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(2 * F.sqrt(area / F.lit(math.pi)), 4).alias("diameter"), F.round(F.least(F.lit(1.0), 4 * math.pi * area / F.pow(around, F.lit(2))), 4).alias("circularity"), F.round(score, 4).alias("score"))


def _unpivoted(rows, words):
    rows = rows.select("conv_id", "turn", F.posexplode(words).alias("i", "cell")).where("cell <> ''")
    return rows.select("conv_id", "turn", F.col("i").cast("long").alias("i"), (F.col("i") % 3).cast("long").alias("j"), "cell")


@BOOK.add("""SELECT conv_id, turn, i, j, cell FROM (SELECT conv_id, turn, unnest(range(len(w))) AS i, i % 3 AS j, unnest(w) AS cell FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)) WHERE cell <> ''""")
def arr11_unpivot_all(spark, sf_dir):
    return _unpivoted(table(spark, sf_dir, "conversations"), F.split("text", " "))


@BOOK.add("""SELECT conv_id, array_to_string(list(turn || ':' || role ORDER BY turn), ';') AS flat, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY conv_id""")
def arr8_flatten(spark, sf_dir):
    part = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(part, lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"])), ";").alias("flat"), F.count_if(F.col("role") == "user").alias("users"))


@BOOK.add("""SELECT source, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS en, count(*) AS n FROM documents GROUP BY source""")
def arr5_histogram(spark, sf_dir):
    """Counts by language as a map for each source, from counts that are aggregated first."""
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    rows = counts.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("h"), F.sum("n").alias("n"))
    return rows.select("source", F.coalesce(F.try_element_at("h", F.lit("en")), F.lit(0).cast("long")).alias("en"), "n")


@BOOK.add("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL AS has_key, CAST(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS BIGINT) AS k FROM events""")
def json1_tolerant(spark, sf_dir):
    """A key of an object; what is broken, an array or no JSON at all counts as an empty object."""
    v = F.try_parse_json("props")
    k = F.try_variant_get(v, "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", k.isNotNull().alias("has_key"), F.coalesce(k, F.lit(-1).cast("long")).alias("k"))


@BOOK.add("""SELECT conv_id, turn, CASE WHEN length(trim(text)) = 0 THEN 'New chat' ELSE substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80) END AS title FROM conversations""".replace("\\\\", "\\"))
def str31_session_title(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.coalesce_blank(text.summary(F.col("text"), 80), F.lit("New chat")).alias("title"))


@BOOK.add("""SELECT p_partkey, CAST(len(list_filter(string_split(lower(p_type), ' '), lambda w: contains('standard brass polished', w))) AS BIGINT) AS score FROM part""")
def str23_keyword_score(spark, sf_dir):
    words = F.split(F.lower("p_type"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.filter(words, lambda w: F.contains(F.lit("standard brass polished"), w))).cast("long").alias("score"))


@BOOK.add("SELECT item_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS phrase FROM benchmark")
def str28_phrases(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("phrase"))


@BOOK.add("""SELECT p_brand, max(CASE WHEN p_size > 45 THEN 1 ELSE 0 END) = 0 AS needs_figure, arg_max(p_partkey, (p_size, p_partkey)) AS best FROM part GROUP BY p_brand""")
def ext8_escalation(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg((~F.bool_or(F.col("p_size") > 45)).alias("needs_figure"), F.max_by("p_partkey", F.struct("p_size", "p_partkey")).alias("best"))


@BOOK.add("""SELECT 'todo' AS state, o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT 'has task', l_orderkey FROM lineitem WHERE l_quantity > 48""")
def ext13_coverage(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    todo = table(spark, sf_dir, "orders").select("o_orderkey").join(items, "o_orderkey", "left_anti")
    return todo.select(F.lit("todo").alias("state"), "o_orderkey").unionByName(items.where("l_quantity > 48").select(F.lit("has task").alias("state"), "o_orderkey").distinct())


@BOOK.add("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((CASE WHEN l_tax > 0.06 THEN 0.8::DOUBLE ELSE 1 END) * (CASE WHEN l_discount > 0.08 THEN 0.7::DOUBLE ELSE 1 END), 4) AS confidence,
array_to_string(list_filter([CASE WHEN l_tax > 0.06 THEN 'tax' END, CASE WHEN l_discount > 0.08 THEN 'discount' END], lambda x: x IS NOT NULL), ';') AS tags FROM lineitem""")
def cht8_point_quality(spark, sf_dir):
    """Penalties multiply and each leaves its tag."""
    rules = [("tax", F.col("l_tax") > 0.06, 0.8), ("discount", F.col("l_discount") > 0.08, 0.7)]
    sure = reduce(lambda a, b: a * b, (F.when(c, F.lit(p)).otherwise(1.0) for _, c, p in rules))
    tags = F.filter(F.array(*(F.when(c, F.lit(t)) for t, c, _ in rules)), lambda t: t.isNotNull())
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(sure, 4).alias("confidence"), F.array_join(tags, ";").alias("tags"))


@BOOK.add("""WITH e AS (SELECT l_suppkey, count(*) FILTER (l_quantity > 49) AS errors, count(*) FILTER (l_quantity < 3) AS warnings FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, errors = 0 AS passed, round(greatest(0, 1 - least(errors * 0.3::DOUBLE + warnings * 0.1::DOUBLE, 1)), 4) AS score FROM e""")
def cht3_verification(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_quantity") > 49).alias("e"), F.count_if(F.col("l_quantity") < 3).alias("w"))
    return rows.select("l_suppkey", (F.col("e") == 0).alias("passed"), F.round(F.greatest(F.lit(0.0), 1 - F.least(F.col("e") * F.lit(0.3) + F.col("w") * F.lit(0.1), F.lit(1.0))), 4).alias("score"))
