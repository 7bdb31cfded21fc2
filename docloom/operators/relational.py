"""Filters, joins, latest-per-key windows, sorts, set operations and changes to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.book import Book, sent, table

BOOK = Book()


def contains_any(columns: Sequence[str], term: str) -> Column:
    """Case-insensitive substring over several columns; % and _ in the term stay wild cards, the term is trimmed."""
    pattern = f"%{term.strip()}%"
    out = F.lit(False)
    for name in columns:
        out = out | F.coalesce(F.col(name).ilike(pattern), F.lit(False))
    return out


def latest(rows: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def where_given(rows: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the arguments that are not None."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return rows


def page(rows: DataFrame, sort: str, allowed: Sequence[str], default: str, unique: str, descending: bool = True, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of rows by a whitelisted column; unknown ones fall back to the default, ties go by ``unique``."""
    name = sort if sort in allowed else default
    own = F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()
    return rows.orderBy(own, F.col(unique).desc() if descending else F.col(unique).asc()).offset(offset).limit(limit)


def replace_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys that ``new`` has, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def normal_tags(tags: Column) -> Column:
    """Trimmed tags without a leading #, blanks and repeats dropped, order kept."""
    clean = F.transform(tags, lambda t: F.trim(F.regexp_replace(F.trim(t), "^#", "")))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


# --- scans and filters ---
@BOOK.add("SELECT count(*) AS n FROM documents WHERE lang = 'en' AND source = 'src3'")
def src1_count_eq(spark, sf_dir):
    return where_given(table(spark, sf_dir, "documents"), lang="en", source="src3", n_chars=None).agg(F.count("*").alias("n"))


@BOOK.add("SELECT doc_id, source FROM documents WHERE text ILIKE '%license%' OR source ILIKE '%license%' OR lang ILIKE '%license%'")
def flt2_keyword(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(contains_any(["text", "source", "lang"], " license ")).select("doc_id", "source")


@BOOK.add("""SELECT doc_id FROM documents WHERE contains(lower(text), 'apache') OR contains(lower(text), 'token') OR contains(lower(source), 'apache') OR contains(lower(source), 'token')""")
def flt3_any_term(spark, sf_dir):
    hay = F.concat_ws("\n", F.lower("text"), F.lower("source"))
    return table(spark, sf_dir, "documents").where(F.exists(F.array(F.lit("apache"), F.lit("token")), lambda t: F.contains(hay, t))).select("doc_id")


@BOOK.add("SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_name ILIKE '%7%' OR o_orderpriority ILIKE '%urgent%' OR c_mktsegment ILIKE '%auto%'")
def flt5_after_join(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return jobs.where(contains_any(["c_name"], "7") | contains_any(["o_orderpriority"], "urgent") | contains_any(["c_mktsegment"], "auto")).select("o_orderkey")


@BOOK.add("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F','P')")
def flt6_widened_status(spark, sf_dir):
    widen = {"done": ["F", "P"]}
    return where_given(table(spark, sf_dir, "orders"), o_orderstatus=widen["done"]).select("o_orderkey")


@BOOK.add("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10'")
def flt7_between(spark, sf_dir):
    low, high = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-01-10"))
    return table(spark, sf_dir, "events").where((F.col("ts") >= low) & (F.col("ts") <= high)).select("event_id")


@BOOK.add("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def flt10_recent(spark, sf_dir):
    from .aggregates import recent

    return recent(table(spark, sf_dir, "events"), "ts").where("recent").select("event_id")


@BOOK.add("""SELECT event_id FROM events WHERE (value IS NULL OR value <= 50) AND (event_type = 'view' OR (event_type = 'error' AND user_id % 5 < 3))""")
def flt11_due_jobs(spark, sf_dir):
    due = F.col("value").isNull() | (F.col("value") <= 50)
    open_ = (F.col("event_type") == "view") | ((F.col("event_type") == "error") & (F.col("user_id") % 5 < 3))
    return table(spark, sf_dir, "events").where(due & open_).select("event_id")


@BOOK.add("""SELECT event_id FROM events WHERE props IS NULL OR props NOT LIKE '%"k": 1%'""")
def flt12_json_text_not_like(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("props").isNull() | ~F.col("props").like('%"k": 1%')).select("event_id")


@BOOK.add("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'N' OR (l_discount >= 0.05 AND l_quantity > 10)""")
def flt14_hiding_rule(spark, sf_dir):
    keep = (F.col("l_returnflag") == "N") | ((F.col("l_discount") >= 0.05) & (F.col("l_quantity") > 10))
    return table(spark, sf_dir, "lineitem").where(keep).select("l_orderkey", "l_linenumber", "l_partkey")


# --- joins ---
@BOOK.add("SELECT DISTINCT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE contains(lower(d.text), 'token') OR l.toxic = 1")
def join1_left_distinct(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    own = docs.where(F.contains(F.lower("text"), F.lit("token"))).select("doc_id")
    return own.union(docs.select("doc_id").join(labels.where("toxic = 1"), "doc_id", "left_semi")).distinct()


@BOOK.add("SELECT d.doc_id, source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1")
def join3_inner_tag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", "quality"), "doc_id")


@BOOK.add("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def join5_three_way(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").where("n_regionkey = 2"), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, sf_dir, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@BOOK.add("""SELECT o_orderkey, count(l_orderkey) AS evidence, count(p_partkey) AS assets FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey AND p_size > 25 GROUP BY o_orderkey""")
def join7_item_evidence_asset(spark, sf_dir):
    items, parts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey")
    per = items.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left").groupBy("l_orderkey").agg(F.count("*").alias("evidence"), F.count("p_partkey").alias("assets"))
    zero = F.lit(0).cast("long")
    return table(spark, sf_dir, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("evidence", zero).alias("evidence"), F.coalesce("assets", zero).alias("assets"))


@BOOK.add("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)")
def join8_semi(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(wanted, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@BOOK.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join9_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@BOOK.add("""SELECT o_orderkey, count(l_orderkey) FILTER (l_returnflag = 'A') AS a, count(l_orderkey) FILTER (l_returnflag = 'N') AS n, count(l_orderkey) FILTER (l_returnflag = 'R') AS r FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def join10_child_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).pivot("l_returnflag", ["A", "N", "R"]).count().toDF("o_orderkey", "a", "n", "r")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(counts, "o_orderkey", "left").fillna(0, ["a", "n", "r"])


@BOOK.add("SELECT n_nationkey, n_name, count(c_custkey) AS documents FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND n_regionkey = c_nationkey % 5 GROUP BY ALL")
def join11_composite_count(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k"), (F.col("c_nationkey") % 5).alias("r")).agg(F.count("*").alias("documents"))
    nation = table(spark, sf_dir, "nation")
    return nation.join(counts, (F.col("n_nationkey") == F.col("k")) & (F.col("n_regionkey") == F.col("r")), "left").select("n_nationkey", "n_name", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))


@BOOK.add("SELECT conv_id, count(*) AS messages, arg_max(text, turn) AS last_message FROM conversations GROUP BY conv_id")
def join12_sessions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max_by("text", "turn").alias("last_message"))


def holders(items: DataFrame, docs: DataFrame, item: str = "item_id", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, doc): every document whose text holds an item's text whole.

    A word of an item with a word on either side stands whole in every text that holds the item, so such items are looked up
    by the rarest of these words: documents give only the words that are such keys, one row each, and true containment is
    checked on what meets. Items without such a word are looked up by their first characters in the same way.
    """
    # A word is a run without white space; the outer two of an item may be parts of longer ones in a text.
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    own = items.select(item, F.col(text).alias("wanted"), words.alias("w"))
    inner = own.where(F.size("w") > 2).select(item, "wanted", F.explode(F.array_distinct(F.expr("slice(w, 2, size(w) - 2)"))).alias("key"))
    known = sent(inner.select("key").distinct())
    seen = docs.select(doc, F.explode(F.array_distinct(words)).alias("key")).join(known, "key", "left_semi")
    counts = seen.groupBy("key").count()
    rarest = inner.join(counts, "key").groupBy(item, "wanted").agg(F.min_by("key", F.struct("count", "key")).alias("key"))
    near = seen.join(rarest, "key").select(doc, item, "wanted").join(docs.select(doc, text), doc)
    found = near.where(F.contains(text, F.col("wanted"))).select(doc, item)
    # Items of one or two words meet texts by a run of up to three of their characters.
    short = own.where((F.size("w") <= 2) & (F.col("wanted") != "")).select(item, "wanted", F.substring("wanted", 1, 3).alias("key"))
    lengths = [r[0] for r in short.select(F.length("key")).distinct().collect()]  # three at most
    if not lengths:
        return found
    runs = F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths))))
    met = docs.select(doc, F.explode(runs).alias("key")).join(sent(short.select("key").distinct()), "key", "left_semi").join(short, "key")
    direct = met.select(doc, item, "wanted").join(docs.select(doc, text), doc).where(F.contains(text, F.col("wanted"))).select(doc, item)
    return found.unionByName(direct)


@BOOK.add("""WITH h AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '') SELECT b.item_id, min(doc_id) AS doc_id FROM benchmark b LEFT JOIN h ON b.item_id = h.item_id GROUP BY b.item_id""")
def join14_containment(spark, sf_dir):
    """First document that holds each item's text whole."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text")
    return items.select("item_id").join(holders(items, docs).groupBy("item_id").agg(F.min("doc_id").alias("doc_id")), "item_id", "left")


@BOOK.add("""SELECT a.doc_id, min(b.doc_id) AS duplicate_of FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id GROUP BY a.doc_id""")
def join19_duplicate_content(spark, sf_dir):
    """The smallest other document with the same text; two least ids of each hash say it for all of its copies."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    least = rows.groupBy("h").agg(F.min("doc_id").alias("one"))
    second = rows.join(least, "h").where("doc_id <> one").groupBy("h").agg(F.min("one").alias("one"), F.min("doc_id").alias("two"))
    return rows.join(second, "h").select("doc_id", F.when(F.col("doc_id") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("duplicate_of"))


@BOOK.add("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 UNION SELECT s_suppkey FROM supplier)")
def join20_still_referenced(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).union(table(spark, sf_dir, "supplier").select("s_suppkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_semi")


# --- windows ---
@BOOK.add("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def win1_latest_job(spark, sf_dir):
    newest = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(newest.alias("e")).select("user_id", "e.event_id", "e.event_type")


@BOOK.add("""SELECT k, event_id FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id, row_number() OVER (PARTITION BY CAST(json_extract_string(props, '$.k') AS BIGINT) ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND k IS NOT NULL""")
def win2_latest_progress(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("long")).where("k is not null")
    return rows.groupBy("k").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@BOOK.add("""SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1""")
def win3_primary_evidence(spark, sf_dir):
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(first.alias("e")).select("l_orderkey", "e.l_linenumber", "e.l_partkey")


@BOOK.add("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def win4_latest_run(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))


@BOOK.add("""WITH p AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (value < before) AS falls, CAST(count(*) FILTER (value < before) AS DOUBLE) / count(*) > 0.3 AS violation FROM p GROUP BY user_id HAVING count(*) >= 3""")
def win5_monotonicity(spark, sf_dir):
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    falls = F.count_if(F.col("value") < F.col("before"))
    rows = table(spark, sf_dir, "events").select("user_id", "value", before.alias("before")).groupBy("user_id").agg(F.count("*").alias("n"), falls.alias("falls"))
    return rows.where("n >= 3").withColumn("violation", F.col("falls") / F.col("n") > 0.3)


@BOOK.add("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS current_section FROM events""")
def win6_forward_fill(spark, sf_dir):
    own = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(own).alias("current_section"))


@BOOK.add("""SELECT conv_id, turn, string_agg(role, ' ' ) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS around FROM conversations""")
def win7_neighbourhood(spark, sf_dir):
    near = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, 3)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(near), " ").alias("around"))


@BOOK.add("""SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_index, unnest(string_split(text, chr(10))) AS line FROM documents""")
def win13_line_index(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", F.col("i").cast("long").alias("line_index"), "line")


# --- sorts ---
@BOOK.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 20 OFFSET 20")
def srt1_page(spark, sf_dir):
    return page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_totalprice", "o_orderdate"], "o_orderdate", "o_orderkey", offset=20)


@BOOK.add("""WITH r AS (SELECT doc_id, n_chars, lang FROM documents ORDER BY doc_id DESC LIMIT 50) SELECT doc_id, n_chars FROM r ORDER BY n_chars DESC, doc_id DESC LIMIT 10""")
def srt4_two_stage(spark, sf_dir):
    newest = table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("doc_id")).limit(50)
    return newest.orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(10)


@BOOK.add("""SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 60""")
def srt12_top_per_group(spark, sf_dir):
    own = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").select("event_type", "event_id", F.row_number().over(own).alias("r")).where("r <= 60").drop("r")


@BOOK.add("""WITH s AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('7:' || p_partkey), p_partkey) AS r, count(DISTINCT p_brand) OVER () AS g FROM part),
q AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY r > greatest(1, 100 // g), r, md5('7:' || p_partkey), p_partkey) AS i FROM s) SELECT p_partkey, p_brand FROM q WHERE i <= 100""")
def srt9_stratified_sample(spark, sf_dir):
    """100 parts: an equal quota of each brand by a seeded hash, then the next of all brands until the number is reached."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.md5(F.concat(F.lit("7:"), F.col("p_partkey").cast("string"))).alias("h"))
    groups = rows.agg(F.countDistinct("p_brand").alias("g"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("h", "p_partkey"))).crossJoin(F.broadcast(groups))
    beyond = F.col("r") > F.greatest(F.lit(1), F.expr("100 div g"))
    return ranked.orderBy(beyond, "r", "h", "p_partkey").limit(100).select("p_partkey", "p_brand")


# --- sets ---
@BOOK.add("""SELECT l_orderkey, l_returnflag, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, substr(sha1(concat_ws('|', l_linestatus, l_returnflag)), 1, 16) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1""")
def set2_candidate_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("key", F.substring(F.sha1(F.concat_ws("|", "l_linestatus", "l_returnflag")), 1, 16))
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return rows.groupBy("l_orderkey", "l_returnflag", "key").agg(first.alias("e")).select("l_orderkey", "l_returnflag", "e.l_partkey")


@BOOK.add("SELECT 'chunk' AS kind, doc_id AS id FROM documents WHERE lang = 'fr' UNION ALL SELECT 'extraction', o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def set3_bag_union(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.lit("chunk").alias("kind"), F.col("doc_id").alias("id"))
    return chunks.unionByName(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.lit("extraction").alias("kind"), F.col("o_orderkey").alias("id")))


@BOOK.add("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set5_intersection(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@BOOK.add("SELECT lower(p_type) AS name, min(p_partkey) AS first_id FROM part GROUP BY 1")
def set9_first_entity(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("name")).agg(F.min("p_partkey").alias("first_id"))


# --- changes ---
@BOOK.add("""WITH e(f, t) AS (VALUES ('O','P'),('P','F')) SELECT o_orderkey, CASE WHEN t IS NULL THEN o_orderstatus ELSE t END AS status, t IS NOT NULL AS changed FROM orders LEFT JOIN e ON o_orderstatus = f""")
def dml2_transition(spark, sf_dir):
    edges = spark.createDataFrame([("O", "P"), ("P", "F")], "f string, t string")
    rows = table(spark, sf_dir, "orders").join(F.broadcast(edges), F.col("o_orderstatus") == F.col("f"), "left")
    return rows.select("o_orderkey", F.coalesce("t", "o_orderstatus").alias("status"), F.col("t").isNotNull().alias("changed"))


@BOOK.add("""SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 9, 9 FROM labels WHERE doc_id % 3 = 0""")
def dml3_replace(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    new = labels.where("doc_id % 3 = 0").select("doc_id", F.lit(9).alias("quality"), F.lit(9).alias("toxic"))
    return replace_keys(labels, new, "doc_id")


@BOOK.add("""SELECT n_nationkey, r_regionkey FROM nation, region WHERE n_regionkey <> r_regionkey""")
def dml4_link_insert(spark, sf_dir):
    """All pairs of two small lookup tables but those that exist; both have a fixed number of rows."""
    nation, region = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), table(spark, sf_dir, "region").select("r_regionkey")
    held = nation.select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    return nation.select("n_nationkey").crossJoin(F.broadcast(region)).join(held, ["n_nationkey", "r_regionkey"], "left_anti")


@BOOK.add("""SELECT doc_id, lang = 'de' AS is_deleted FROM documents""")
def dml5_soft_delete(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "de", F.lit(True)).otherwise(F.lit(False)).alias("is_deleted"))


@BOOK.add("SELECT doc_id, CASE WHEN source = 'src1' THEN 'renamed' WHEN source = 'src2' THEN NULL ELSE source END AS collection FROM documents")
def dml7_rename(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src1", "renamed").when(F.col("source") == "src2", F.lit(None)).otherwise(F.col("source")).alias("collection"))


@BOOK.add("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.quality, a.quality) AS quality FROM labels a FULL JOIN (SELECT doc_id, CASE WHEN n_chars >= 1000 THEN 1 WHEN n_chars < 200 THEN 0 END AS quality FROM documents) b ON a.doc_id = b.doc_id""")
def dml9_upsert_all(spark, sf_dir):
    """All labels, merged with a quality by length of all documents; a length that says nothing leaves the label as it is."""
    long = F.when(F.col("n_chars") >= 1000, 1).when(F.col("n_chars") < 200, 0)
    old, new = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("old")), table(spark, sf_dir, "documents").select("doc_id", long.alias("new"))
    return old.join(new, "doc_id", "full").select("doc_id", F.coalesce("new", "old").alias("quality"))


def _migrated(orders, labels):
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    first = orders.select(F.col("o_orderkey").alias("job_id"), status.alias("status"))
    second = labels.select(F.col("doc_id").alias("job_id"), F.lit("succeeded").alias("status")).join(first, "job_id", "left_anti")
    return first.unionByName(second)


@BOOK.add("""SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'queued' ELSE 'running' END AS status FROM orders
UNION ALL SELECT doc_id, 'succeeded' FROM labels WHERE doc_id NOT IN (SELECT o_orderkey FROM orders)""")
def dml11_migrate_all(spark, sf_dir):
    return _migrated(table(spark, sf_dir, "orders"), table(spark, sf_dir, "labels"))


@BOOK.add("""WITH i AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'pending' WHEN l_linestatus = 'F' THEN 'done' ELSE 'failed' END AS s FROM lineitem)
SELECT l_orderkey, count(*) FILTER (s = 'pending') AS pending, CASE WHEN count(*) FILTER (s = 'pending') > 0 THEN 'pending' WHEN count(*) FILTER (s = 'done') > 0 THEN 'done' ELSE 'failed' END AS job FROM i GROUP BY l_orderkey""")
def dml12_recover(spark, sf_dir):
    state = F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), "pending").when(F.col("l_linestatus") == "F", "done").otherwise("failed")
    pending, done = F.count_if(F.col("s") == "pending"), F.count_if(F.col("s") == "done")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", state.alias("s")).groupBy("l_orderkey").agg(pending.alias("pending"), F.when(pending > 0, "pending").when(done > 0, "done").otherwise("failed").alias("job"))
