"""Dashboard aggregates over library rows, jobs, items and events.

All of them are one pass of conditional aggregates with partial sums before the shuffle; totals that every row needs are
one-row frames and joined as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.book import Book, table

BOOK = Book()


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def success_rate(done: Column, failed: Column, scale: float = 1.0, places: int = 4) -> Column:
    """done / (done + failed), 0 where nothing has ended."""
    return F.round(F.coalesce(F.try_divide(done * F.lit(scale), (done + failed).cast("double")), F.lit(0.0)), places)


def status_counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def with_ratio(counts: DataFrame, n: str = "n", places: int = 4) -> DataFrame:
    """Counts with their share of the total of all rows, from a one-row total."""
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("ratio", F.round(F.col(n) / F.col("_total"), places)).drop("_total")


def recent(rows: DataFrame, ts: str, days: int = 7) -> DataFrame:
    """``rows`` with ``recent``: within so many days of the latest time stamp."""
    last = rows.agg(F.max(ts).alias("_as_of"))
    return rows.crossJoin(F.broadcast(last)).withColumn("recent", F.col(ts) >= F.col("_as_of") - F.expr(f"INTERVAL {days} DAYS")).drop("_as_of")


@BOOK.add("""
WITH e AS (SELECT *, ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS recent FROM events)
SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed,
       count(*) FILTER (recent) AS recent_7d,
       round(coalesce(CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) / nullif(count(*) FILTER (event_type IN ('purchase','error')), 0), 0.0), 4) AS success_rate
FROM e""")
def agg1_dashboard(spark, sf_dir):
    done, failed = count_where(F.col("event_type") == "purchase"), count_where(F.col("event_type") == "error")
    return recent(table(spark, sf_dir, "events"), "ts").agg(
        F.count("*").alias("total"), done.alias("done"), failed.alias("failed"), count_where(F.col("recent")).alias("recent_7d"), success_rate(done, failed).alias("success_rate")
    )


@BOOK.add("SELECT source, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM documents), 4) AS ratio FROM documents GROUP BY source")
def agg2_source_ratio(spark, sf_dir):
    return with_ratio(status_counts(table(spark, sf_dir, "documents"), "source"))


@BOOK.add("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def agg3_status_counts(spark, sf_dir):
    return status_counts(table(spark, sf_dir, "orders"), "o_orderstatus")


@BOOK.add("""
SELECT count(*) AS total, count(*) FILTER (n_chars > 500) AS parsed, count(*) FILTER (lang = 'en') AS english, count(l.doc_id) AS labelled,
       count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.toxic = 1) AS toxic, round(avg(l.quality), 4) AS avg_quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def agg4_paper_dashboard(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
    return docs.select("doc_id", "lang", "n_chars").join(labels, F.col("doc_id") == F.col("l_id"), "left").agg(
        F.count("*").alias("total"), count_where(F.col("n_chars") > 500).alias("parsed"), count_where(F.col("lang") == "en").alias("english"), F.count("l_id").alias("labelled"),
        count_where(F.col("quality") == 1).alias("good"), count_where(F.col("toxic") == 1).alias("toxic"), F.round(F.avg("quality"), 4).alias("avg_quality"),
    )


@BOOK.add("""
WITH d AS (SELECT o_orderkey, o_orderstatus, o_orderdate, max(l_shipdate) AS ended FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT count(*) AS jobs, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS running,
       round(coalesce(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus IN ('F','P')), 0), 0.0), 1) AS success_rate,
       round(avg(greatest(0.0::DOUBLE, (epoch_us(ended) - epoch_us(o_orderdate)) / 1e6::DOUBLE)), 1) AS mean_duration_s,
       max(o_orderkey) FILTER (o_orderdate = (SELECT max(o_orderdate) FROM orders)) AS latest_job FROM d""")
def agg5_job_metrics(spark, sf_dir):
    ended = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ended"))
    jobs = table(spark, sf_dir, "orders").join(ended, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    spent = F.greatest(F.lit(0.0), (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / F.lit(1e6))
    ok, bad = count_where(F.col("o_orderstatus") == "F"), count_where(F.col("o_orderstatus") == "P")
    return jobs.agg(
        F.count("*").alias("jobs"), ok.alias("succeeded"), bad.alias("failed"), count_where(F.col("o_orderstatus") == "O").alias("running"), success_rate(ok, bad, 100.0, 1).alias("success_rate"),
        F.round(F.avg(spent), 1).alias("mean_duration_s"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_job"),
    )


@BOOK.add("SELECT o_custkey AS job, count(*) AS items FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def agg6_items_per_job(spark, sf_dir):
    per_run = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    runs = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return runs.join(per_run, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("job")).agg(F.sum("n").alias("items"))


@BOOK.add("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'P') AS running,
count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice IS NULL) AS broken FROM orders""")
def agg7_health(spark, sf_dir):
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("total"), count_where(status == "O").alias("queued"), count_where(status == "P").alias("running"), count_where(status == "F").alias("finished"), count_where(F.col("o_totalprice").isNull()).alias("broken")
    )


@BOOK.add("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus IN ('O','P')")
def agg8_active_parents(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_custkey").distinct()


@BOOK.add("SELECT count(*) AS figures FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def agg9_figures_of_ids(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(wanted, "l_partkey", "left_semi").agg(F.count("*").alias("figures"))


@BOOK.add("""SELECT l_orderkey, count(*) AS items, count(*) FILTER (l_linestatus = 'F') AS done, count(*) FILTER (l_returnflag = 'R') AS failed,
CASE WHEN count(*) FILTER (l_linestatus = 'O') > 0 THEN 'running' WHEN count(*) FILTER (l_returnflag = 'R') = count(*) THEN 'failed' ELSE 'succeeded' END AS status
FROM lineitem GROUP BY l_orderkey""")
def agg10_job_recount(spark, sf_dir):
    failed, left = count_where(F.col("l_returnflag") == "R"), count_where(F.col("l_linestatus") == "O")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("items"), count_where(F.col("l_linestatus") == "F").alias("done"), failed.alias("failed"),
        F.when(left > 0, "running").when(failed == F.count("*"), "failed").otherwise("succeeded").alias("status"),
    )


@BOOK.add("""WITH b AS (SELECT CASE WHEN l_quantity IS NULL THEN 'not_found' WHEN l_returnflag = 'R' THEN 'figure' WHEN l_returnflag = 'A' THEN 'table' ELSE 'text' END AS bucket FROM lineitem)
SELECT count(*) FILTER (bucket = 'figure') AS figures, count(*) FILTER (bucket = 'table') AS tables, count(*) FILTER (bucket = 'text') AS texts, count(*) FILTER (bucket = 'not_found') AS not_found, count(*) AS total FROM b""")
def agg11_structured_summary(spark, sf_dir):
    flag = F.col("l_returnflag")
    bucket = F.when(F.col("l_quantity").isNull(), "not_found").when(flag == "R", "figure").when(flag == "A", "table").otherwise("text")
    rows = table(spark, sf_dir, "lineitem").select(bucket.alias("bucket"))
    return rows.agg(*(count_where(F.col("bucket") == k).alias(v) for k, v in (("figure", "figures"), ("table", "tables"), ("text", "texts"), ("not_found", "not_found"))), F.count("*").alias("total"))


@BOOK.add("""SELECT n_name, count(c_custkey) AS runs, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, round(coalesce(sum(c_acctbal), 0), 2) AS balance
FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name""")
def agg12_catalog_stats(spark, sf_dir):
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("runs"), count_where(F.col("c_mktsegment") == "BUILDING").alias("building"), F.sum("c_acctbal").alias("balance"))
    zero = F.lit(0).cast("long")
    return table(spark, sf_dir, "nation").join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        "n_name", F.coalesce("runs", zero).alias("runs"), F.coalesce("building", zero).alias("building"), F.round(F.coalesce("balance", F.lit(0.0)), 2).alias("balance")
    )


@BOOK.add("""SELECT source, count(*) AS pages, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (n_chars < 200) AS short, string_agg(DISTINCT lang, '|' ORDER BY lang) AS langs,
count(*) FILTER (n_chars < 200) * 2 >= count(*) AS mostly_short FROM documents GROUP BY source""")
def agg13_parse_quality(spark, sf_dir):
    short = count_where(F.col("n_chars") < 200)
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("pages"), F.sum("n_chars").alias("chars"), short.alias("short"), F.array_join(F.array_sort(F.collect_set("lang")), "|").alias("langs"), (short * 2 >= F.count("*")).alias("mostly_short")
    )


@BOOK.add("""SELECT o_orderpriority, count(*) FILTER (o_totalprice < 100000) AS accepted, count(*) FILTER (o_totalprice >= 100000) AS review,
string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY o_orderpriority""")
def agg15_quality_summary(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        count_where(F.col("o_totalprice") < 100000).alias("accepted"), count_where(F.col("o_totalprice") >= 100000).alias("review"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "|").alias("statuses")
    )


@BOOK.add("""SELECT p_brand, p_size, count(*) AS rows, round(sum(p_retailprice), 2) AS total, array_to_string(list_slice(list(p_name ORDER BY p_name, p_partkey), 1, 3), '|') AS examples
FROM part GROUP BY p_brand, p_size""")
def agg16_audit_groups(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy("p_name", "p_partkey"))
    ranked = table(spark, sf_dir, "part").withColumn("rank", rank)
    names = F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "p_name"))))
    return ranked.groupBy("p_brand", "p_size").agg(
        F.count("*").alias("rows"), F.round(F.sum("p_retailprice"), 2).alias("total"), F.array_join(F.transform(names, lambda x: x["p_name"]), "|").alias("examples")
    )


@BOOK.add("""WITH t AS (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) SELECT tag, count(*) AS n FROM t GROUP BY tag ORDER BY n DESC, tag LIMIT 20""")
def agg17_top_tags(spark, sf_dir):
    tags = table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("tag"))
    return status_counts(tags, "tag").orderBy(F.desc("n"), "tag").limit(20)


@BOOK.add("""WITH p AS (SELECT l_suppkey, l_quantity AS x, l_extendedprice AS y, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
t AS (SELECT l_suppkey, any_value(n) AS n, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, sum(y) FILTER (i <= n // 3) / any_value(n // 3) AS head, sum(y) FILTER (i > n - (n + 2) // 3) / any_value(n // 3) AS tail FROM p GROUP BY l_suppkey)
SELECT l_suppkey AS series, n, x_min, x_max, y_min, y_max, CASE WHEN n < 3 THEN 'flat' WHEN tail > head * 1.2 THEN 'increasing' WHEN tail < head * 0.8 THEN 'decreasing' ELSE 'flat' END AS trend FROM t""")
def agg18_series_profile(spark, sf_dir):
    """Range and trend of each series; the last third has one point more where the count does not divide, as it is divided by the rounded-down third."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    own = Window.partitionBy("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", F.row_number().over(own.orderBy(*order)).alias("i"), F.count("*").over(own).alias("n"))
    third = F.expr("n div 3")
    rows = rows.groupBy("l_suppkey").agg(
        F.max("n").alias("n"), F.min("l_quantity").alias("x_min"), F.max("l_quantity").alias("x_max"), F.min("l_extendedprice").alias("y_min"), F.max("l_extendedprice").alias("y_max"),
        F.try_divide(F.sum(F.when(F.col("i") <= third, F.col("l_extendedprice"))), F.max(third)).alias("head"), F.try_divide(F.sum(F.when(F.col("i") > F.col("n") - F.expr("(n + 2) div 3"), F.col("l_extendedprice"))), F.max(third)).alias("tail"),
    )
    trend = F.when(F.col("n") < 3, "flat").when(F.col("tail") > F.col("head") * 1.2, "increasing").when(F.col("tail") < F.col("head") * 0.8, "decreasing").otherwise("flat")
    return rows.select(F.col("l_suppkey").alias("series"), "n", "x_min", "x_max", "y_min", "y_max", trend.alias("trend"))


@BOOK.add("""SELECT p_brand, count(*) AS n, round(avg(p_size), 4) AS mean, round(quantile_cont(p_size, 0.1), 4) AS p10, round(quantile_cont(p_size, 0.5), 4) AS p50, round(quantile_cont(p_size, 0.9), 4) AS p90 FROM part GROUP BY p_brand""")
def agg19_size_distribution(spark, sf_dir):
    cuts = F.percentile("p_size", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 4).alias("mean"), cuts.alias("q")).select("p_brand", "n", "mean", *(F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(("p10", "p50", "p90"))))


@BOOK.add("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY event_type)
SELECT event_id, e.event_type FROM events e JOIN s USING (event_type) WHERE sd > 0 AND abs(value - m) / sd > 3""")
def agg20_outliers(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    stats = events.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    # One row a type: with few types adaptive execution sends them to all tasks, so that no type's events move.
    return events.join(stats, "event_type").where((F.col("sd") > 0) & (F.abs(F.col("value") - F.col("m")) / F.col("sd") > 3)).select("event_id", "event_type")


@BOOK.add("""WITH s(status) AS (VALUES ('F'),('O'),('P'),('X')) SELECT status, count(o_orderkey) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS first_pass, count(o_orderkey) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS second_pass
FROM s LEFT JOIN orders ON status = o_orderstatus GROUP BY status""")
def agg21_zero_filled_status(spark, sf_dir):
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(count_where(early).alias("first_pass"), count_where(~early).alias("second_pass"))
    return spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], "status string").join(counts, "status", "left").fillna(0)


@BOOK.add("""SELECT count(*) AS total, count(embedding) AS embedded, count(DISTINCT label) AS labels, round(100.0::DOUBLE * count(embedding) / count(*), 2) AS percent FROM embeddings""")
def agg22_embedding_coverage(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"), F.countDistinct("label").alias("labels"), F.round(F.lit(100.0) * F.count("embedding") / F.count("*"), 2).alias("percent"))


@BOOK.add("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (contains(line, 'License')) AS marked FROM l GROUP BY doc_id""")
def agg23_line_counts(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: F.contains(x, F.lit("License")))).cast("long").alias("marked"))


@BOOK.add("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT conv_id, string_agg(text, '；' ORDER BY i) AS answer FROM r WHERE i <= 3 GROUP BY conv_id""")
def agg24_answer_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("i <= 3")
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "；").alias("answer"))


@BOOK.add("SELECT source, count(*) AS documents, count(DISTINCT sha256(text)) AS distinct_texts FROM documents GROUP BY source")
def agg25_distinct_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", F.sha2(F.col("text").cast("binary"), 256).alias("h")).groupBy("source").agg(F.count("*").alias("documents"), F.countDistinct("h").alias("distinct_texts"))


@BOOK.add("""SELECT l_linenumber AS x, coalesce(CAST(min(l_quantity) FILTER (l_returnflag = 'A') AS VARCHAR), '/') AS a, coalesce(CAST(min(l_quantity) FILTER (l_returnflag = 'N') AS VARCHAR), '/') AS n,
coalesce(CAST(min(l_quantity) FILTER (l_returnflag = 'R') AS VARCHAR), '/') AS r FROM lineitem GROUP BY l_linenumber""")
def agg26_pivot(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("x")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.min("l_quantity"))
    return wide.select("x", *(F.coalesce(F.col(c).cast("string"), F.lit("/")).alias(c.lower()) for c in ("A", "N", "R")))
