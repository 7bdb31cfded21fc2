"""Streams of events and of queued jobs. Every operator takes a batch or a streaming DataFrame; the queries run the batch twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.plans.book import Book, table

BOOK = Book()
QUEUE = "task_type string, job_id string, ts timestamp"


def tumbling(events: DataFrame, width: str, late: str | None = None, ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts by key and window of fixed width; ``late`` is the watermark of a stream."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str | None = None, ts: str = "ts") -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None, ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of each key: events no further apart than the gap."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "n")


def queue(spark: SparkSession, path: str, kinds: list[str], files_per_trigger: int = 100) -> DataFrame:
    """Messages of the wanted kinds from JSON lines in a folder; malformed and unknown ones are skipped."""
    return messages(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), kinds)


def messages(lines: DataFrame, kinds: list[str]) -> DataFrame:
    """The messages of the wanted kinds in lines of JSON (value), of a stream or a batch."""
    m = F.from_json("value", QUEUE + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.select(m.alias("m")).select("m.*")
    return rows.where(F.col("_corrupt_record").isNull() & F.col("job_id").isNotNull() & F.col("task_type").isin(kinds)).drop("_corrupt_record")


def requeued(items: DataFrame, as_of: str, seconds: int) -> DataFrame:
    """Items after a restart: what was in work and has not moved for ``seconds`` waits again, once; the rest is as it was.

    ``items``: job_id, state, touched, requeued (how often already).
    """
    stuck = (F.col("state") == "processing") & (F.col("requeued") < 1) & (F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(F.col("touched").cast("timestamp")) > seconds)
    return items.withColumns({"state": F.when(stuck, "pending").otherwise(F.col("state")), "requeued": F.when(stuck, F.col("requeued") + 1).otherwise(F.col("requeued"))})


def once_each(messages: DataFrame, key: str = "job_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each job once within the watermark, so that a repeated submit starts nothing."""
    if messages.isStreaming:
        return messages.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return messages.dropDuplicates([key])


def job_progress(items: DataFrame, key: str = "job_id") -> DataFrame:
    """Counts of a job's items by state and its percentage; run it in update mode on a stream."""
    done, failed = F.count_if(F.col("state") == "done"), F.count_if(F.col("state") == "failed")
    return items.groupBy(key).agg(F.count("*").alias("items"), done.alias("done"), failed.alias("failed"), F.round(F.lit(100.0) * (done + failed) / F.count("*"), 1).alias("percent"))


def drain(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off all that is there, once: batches already committed in the checkpoint are not handled again after a restart."""
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(availableNow=True).start()


def over_rate(requests: DataFrame, most: int, seconds: int = 60, ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Requests that come when their key already has ``most`` in the seconds before."""
    from pyspark.sql import Window

    own = Window.partitionBy(key).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-seconds + 1, 0)
    return requests.withColumn("recent", F.count("*").over(own)).where(F.col("recent") > most)


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@BOOK.add("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stm_tumbling(spark, sf_dir):
    out = tumbling(_events(spark, sf_dir), "1 day")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@BOOK.add("""SELECT CAST(s AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1""")
def stm_sliding(spark, sf_dir):
    return sliding(_events(spark, sf_dir), "12 hours", "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@BOOK.add("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stm_sessions(spark, sf_dir):
    return sessions(_events(spark, sf_dir), "12 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@BOOK.add("""SELECT user_id AS job_id, count(*) AS items, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'error') AS failed,
round(100.0::DOUBLE * count(*) FILTER (event_type IN ('purchase','error')) / count(*), 1) AS percent FROM events GROUP BY user_id""")
def stm3_job_progress(spark, sf_dir):
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("open")
    return job_progress(_events(spark, sf_dir).select(F.col("user_id").alias("job_id"), state.alias("state")))


@BOOK.add("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS recent FROM events QUALIFY recent > 2""")
def stm5_over_rate(spark, sf_dir):
    return over_rate(_events(spark, sf_dir), 2, 86_400).select("event_id", "recent")


_LINES = """CASE event_id % 6 WHEN 0 THEN '{broken' WHEN 1 THEN '{"task_type": "other", "job_id": "x"}' WHEN 2 THEN '{"task_type": "parse"}' ELSE concat('{"task_type": "', CASE WHEN event_id % 2 = 0 THEN 'parse' ELSE 'extract' END, '", "job_id": "j', event_id % 100, '", "ts": "2024-01-01T00:00:00Z"}') END"""


@BOOK.add("""SELECT CASE WHEN event_id % 2 = 0 THEN 'parse' ELSE 'extract' END AS task_type, count(*) AS n FROM events WHERE event_id % 6 IN (3, 4, 5) GROUP BY 1""")
def stm1_queue_messages(spark, sf_dir):
    """Messages of the wanted kinds; broken ones, ones of other kinds and ones without a job are passed over (also SRC-10)."""
    return messages(table(spark, sf_dir, "events").select(F.expr(_LINES).alias("value")), ["parse", "extract"]).groupBy("task_type").agg(F.count("*").alias("n"))


@BOOK.add("""SELECT DISTINCT 'j' || event_id % 100 AS job_id FROM events WHERE event_id % 6 IN (3, 4, 5)""")
def stm2_submitted_once(spark, sf_dir):
    """Each job once, however often it was submitted."""
    return once_each(messages(table(spark, sf_dir, "events").select(F.expr(_LINES).alias("value")), ["parse", "extract"])).select("job_id")


@BOOK.add("""SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 2 = 0 AND epoch(TIMESTAMP '2024-01-20') - epoch(date_trunc('second', ts)) > 600000 THEN 'pending' WHEN event_type = 'click' THEN 'processing' ELSE 'done' END AS state, CASE WHEN event_type = 'click' AND event_id % 2 = 0 AND epoch(TIMESTAMP '2024-01-20') - epoch(date_trunc('second', ts)) > 600000 THEN 1 ELSE event_id % 2 END AS requeued FROM events""")
def stm4_requeue_once(spark, sf_dir):
    items = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "processing").otherwise("done").alias("state"), F.col("ts").alias("touched"), (F.col("event_id") % 2).alias("requeued"))
    return requeued(items, "2024-01-20 00:00:00", 600_000).select("event_id", "state", "requeued")


@BOOK.add("""SELECT event_id, 'j' || event_id % 100 AS job_id FROM events WHERE event_id % 6 IN (3, 5)""")
def src10_consumed(spark, sf_dir):
    """What a consumer of one kind takes from the queue, in the order of the messages."""
    lines = table(spark, sf_dir, "events").select("event_id", F.expr(_LINES).alias("value"))
    m = F.from_json("value", QUEUE)
    return lines.select("event_id", m.alias("m")).where("m.task_type = 'extract' and m.job_id is not null").select("event_id", "m.job_id")
