"""Keyed state with timers: progress of jobs with items queued again once, tries with backoff, and a sliding rate limit.

Each operator has a processor for ``transformWithState`` (map, value and list state, event-time timers) and a twin over a
batch that gives the same rows. The processors take the rows of a key in order of time and act on due times before rows
that come after them, so what they put out does not depend on where batches end or how often a stream is restarted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.plans.book import Book, scratch, table
from docloom.streaming.events import drain

BOOK = Book()
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATES = ("pending", "processing", "done", "failed")
PROGRESS = "job_id long, item_id long, kind string, ms long, items long, pending long, processing long, done long, failed long, percent double, version long"
TRIES = "job_id long, attempt int, ms long, status string, next_ms long"
ADMITTED = "key long, id long, ms long, admitted_ms long"
#: Jobs with consecutive ids that share a call of a processor, of progress and of tries, and items of a job that are read and
#: written together: a call, a timer and every access to state cost far more than a row does.
JOBS_AT_ONCE, JOBS_OF_TRIES, ITEMS_AT_ONCE = 16, 1_000, 64
#: Times are milliseconds in state and in rows, so that no time zone of a worker matters.
ProgressRow, TryRow, AdmittedRow = (Row(*(c.split()[0] for c in schema.split(", "))) for schema in (PROGRESS, TRIES, ADMITTED))


def _plain(waiting: Row) -> tuple:
    """A waiting job as tuples: rows in rows cannot be written to state."""
    return waiting[0], tuple(waiting[1]), *waiting[2:]


class _Jobs:
    """State of one call of JobProgress: counts and waiting times of its jobs, and the parts of their items that were read."""

    def __init__(self, state: Any, items: Any):
        counts, waiting, self.timer = state.get() or ((), (), None)
        self.state, self.items, self.parts = state, items, {}
        self.counts = {job: dict(zip(("items", *STATES, "version"), rest, strict=True)) for job, *rest in counts}
        self.waiting = {(job, item): due for job, item, due in waiting}

    def part(self, job: int, item: int) -> dict[int, tuple]:
        """The items that are kept with this one: state, time of the last change, its id, when it is due, times queued again."""
        at = (job, None if item is None else item // ITEMS_AT_ONCE)
        if at not in self.parts:
            held = self.items.getValue(at) if self.items.containsKey(at) else None
            self.parts[at] = {i: tuple(rest) for i, *rest in held[0]} if held else {}
        return self.parts[at]

    def requeue(self, job: int, item: int, at: int) -> Iterator[Row]:
        state, _, number, due, requeued = self.part(job, item)[item]
        if state == "processing" and due == at and not requeued:
            self.part(job, item)[item] = ("pending", at, number, 0, 1)
            self.waiting.pop((job, item), None)
            counts = self.counts[job]
            counts["processing"], counts["pending"], counts["version"] = counts["processing"] - 1, counts["pending"] + 1, counts["version"] + 1
            yield self.row(job, "requeued", item, at)

    def row(self, job: int, kind: str, item: int | None, ms: int) -> Row:
        counts = self.counts[job]
        done = counts["done"] + counts["failed"]
        return ProgressRow(job, item, kind, ms, *(counts[c] for c in ("items", *STATES)), round(100.0 * done / counts["items"], 1), counts["version"])

    def keep(self, handle: StatefulProcessorHandle) -> None:
        """Write what was read, once, and set the timer to the first due time."""
        for at, part in self.parts.items():
            self.items.updateValue(at, ([(i, *rest) for i, rest in part.items()],))
        due = min(self.waiting.values(), default=None)
        if due != self.timer:
            if self.timer is not None:
                handle.deleteTimer(self.timer)
            if due is not None:
                handle.registerTimer(due)
        self.state.update(([(job, *c.values()) for job, c in self.counts.items()], [(*at, ms) for at, ms in self.waiting.items()], due))


class JobProgress(StatefulProcessor):
    """Rows of items' changes (job_id, item_id, state, ts, id) by runs of jobs: progress after each batch, and items queued again.

    An item that is in work and has not moved for ``stale`` seconds waits again, once. A change that is older than the
    item's last one is passed over. State: items in parts of ITEMS_AT_ONCE, so that a part is read and written once a batch;
    counts of the jobs and which items are due when, with one timer for the first of them.
    """

    def __init__(self, stale: int):
        self.stale = stale * 1_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "job_id long, part long", "items array<struct<item_id: long, state: string, moved: long, id: long, due: long, requeued: int>>")
        counts = ", ".join(f"{c}: long" for c in ("job_id", "items", *STATES, "version"))
        self.jobs = handle.getValueState("jobs", f"counts array<struct<{counts}>>, waiting array<struct<job_id: long, item_id: long, due: long>>, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        own, last = _Jobs(self.jobs, self.items), {}
        for r in sorted(rows, key=lambda r: (r.ms, r.id)):
            job, item, ms = r.job_id, r.item_id, r.ms
            counts = own.counts.setdefault(job, dict.fromkeys(("items", *STATES, "version"), 0))
            part = own.part(job, item)
            last.setdefault(job, 0)
            if item in part:
                if part[item][3] and part[item][3] < ms:
                    yield from own.requeue(job, item, part[item][3])
                before, moved, number, _, requeued = part[item]
                if (moved, number) > (ms, r.id):
                    continue
                counts[before] -= 1
            else:
                requeued = 0
                counts["items"] += 1
            due = ms + self.stale if r.state == "processing" and not requeued else 0
            own.waiting.pop((job, item), None)
            if due:
                own.waiting[job, item] = due
            counts[r.state] += 1
            part[item] = (r.state, ms, r.id, due, requeued)
            last[job] = ms
        for job, ms in last.items():
            own.counts[job]["version"] += 1
            yield own.row(job, "progress", None, ms)
        own.keep(self.handle)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        own, now = _Jobs(self.jobs, self.items), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        own.timer = None
        for at, (job, item) in sorted((due, at) for at, due in own.waiting.items() if due <= now):
            yield from own.requeue(job, item, at)
        own.keep(self.handle)


class Retries(StatefulProcessor):
    """Jobs (job_id, ts and whatever ``failed`` needs) by runs of ids, each tried until it is done or failed ``most`` times; later tries come by timer.

    ``failed`` (row as a dictionary, attempt) says whether a try fails. The wait before the next is ``delay`` seconds times
    ``factor`` for each try before. A job that is submitted again is passed over. State: the ids of a run that have come and
    its jobs that wait, no more than JOBS_OF_TRIES of either, with one timer for the first of them.
    """

    def __init__(self, failed: Callable[[dict, int], bool], columns: str, delay: int, most: int, factor: int = 1):
        self.failed, self.columns, self.delay, self.most, self.factor = failed, columns, delay, most, factor
        self.names = [c.split()[0] for c in columns.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", f"seen array<long>, waiting array<struct<job_id: long, job: struct<{self.columns}>, attempt: int, due: long>>, timer long")

    def _tries(self, number: int, job: tuple, attempt: int, ms: int, now: int, waiting: list[tuple]) -> Iterator[Row]:
        """The try at ``ms`` and all that are due by ``now``, as after a long pause; the next one is added to ``waiting``."""
        given = dict(zip(self.names, job, strict=True))
        while True:
            failed = self.failed(given, attempt)
            again = ms + self.delay * 1_000 * self.factor ** (attempt - 1) if failed and attempt < self.most else None
            yield TryRow(number, attempt, ms, "done" if not failed else "failed" if again is None else "pending", again)
            if again is None or again > now:
                break
            ms, attempt = again, attempt + 1
        if again is not None:
            waiting.append((number, job, attempt, again))

    def _keep(self, seen: list[int], waiting: list[tuple], timer: int | None) -> None:
        due = min((w[3] for w in waiting), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.jobs.update((seen, waiting, due))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        seen, waiting, timer = self.jobs.get() or ([], [], None)
        known, first, waiting = set(seen), {}, [_plain(w) for w in waiting]
        for r in rows:
            if r.job_id not in known and (r.job_id not in first or r.ms < first[r.job_id].ms):
                first[r.job_id] = r
        for number, r in first.items():
            yield from self._tries(number, tuple(r[n] for n in self.names), 1, r.ms, 0, waiting)
        if first:
            self._keep([*seen, *first], waiting, timer)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        (seen, jobs, _), now = self.jobs.get(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting = [_plain(w) for w in jobs if w[3] > now]
        for number, job, attempt, due in map(_plain, jobs):
            if due <= now:
                yield from self._tries(number, job, attempt + 1, due, now, waiting)
        self._keep(seen, waiting, None)


class SlidingLimit(StatefulProcessor):
    """Requests (id, ts) of a key, each let through as soon as fewer than ``most`` were in the ``seconds`` before.

    List state holds the last ``most`` times, the sliding window; a request waits until the oldest of them has left it.
    """

    def __init__(self, most: int, seconds: int):
        self.most, self.window = most, seconds * 1_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        times = [t[0] for t in self.times.get()] if self.times.exists() else []
        for r in sorted(rows, key=lambda r: (r.ms, r.id)):
            at = r.ms
            if len(times) == self.most:
                at = max(at, times.pop(0) + self.window)
            times.append(at)
            yield AdmittedRow(key[0], r.id, r.ms, at)
        self.times.put([(t,) for t in times])


def progress_stream(changes: DataFrame, stale: int, late: str = "0 seconds") -> DataFrame:
    """Progress rows of a stream of changes (job_id, item_id, state, ts, id); the last version of a job is its state now."""
    rows = changes.withWatermark("ts", late).select(F.expr(f"job_id div {JOBS_AT_ONCE}").alias("jobs"), "job_id", "item_id", "state", "id", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("jobs").transformWithState(JobProgress(stale), PROGRESS, "Append", "EventTime").withColumn("at", F.timestamp_millis("ms")).drop("ms")


def progress_batch(changes: DataFrame, stale: int, until: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(progress, requeued) of all changes: what the stream has put out once its time has come to ``until`` (one row, ms).

    An item is queued again at the first change that puts it in work without another one for ``stale`` seconds.
    """
    own = Window.partitionBy("job_id", "item_id").orderBy("ts", "id")
    rows = changes.withColumns({"ms": F.unix_millis("ts"), "next": F.lead(F.unix_millis("ts")).over(own), "last": F.row_number().over(own.orderBy(F.desc("ts"), F.desc("id"))) == 1})
    rows = rows.crossJoin(F.broadcast(until.select("until"))).withColumn("due", F.col("ms") + stale * 1_000)
    stuck = (F.col("state") == "processing") & (F.col("due") <= F.col("until")) & (F.col("next").isNull() | (F.col("next") > F.col("due")))
    items = rows.groupBy("job_id", "item_id").agg(F.max(F.when(F.col("last"), F.struct("state", "ms"))).alias("end"), F.min(F.when(stuck, F.col("due"))).alias("at"))
    state = F.when(F.coalesce((F.col("end.state") == "processing") & (F.col("at") > F.col("end.ms")), F.lit(False)), "pending").otherwise(F.col("end.state"))
    items = items.select("job_id", "item_id", "at", state.alias("state"))
    progress = items.groupBy("job_id").agg(
        F.count("*").alias("items"), *(F.count_if(F.col("state") == s).alias(s) for s in STATES), F.round(F.lit(100.0) * F.count_if(F.col("state").isin("done", "failed")) / F.count("*"), 1).alias("percent")
    )
    return progress, items.where("at is not null").select("job_id", "item_id", F.timestamp_millis("at").alias("at"))


def tries_stream(jobs: DataFrame, failed: Callable[[dict, int], bool], columns: str, delay: int, most: int, factor: int = 1, late: str = "0 seconds") -> DataFrame:
    """Each try of a stream of jobs (job_id, ts, ``columns``) with its time, outcome and next time."""
    processor = Retries(failed, columns, delay, most, factor)
    rows = jobs.withWatermark("ts", late).select(F.expr(f"job_id div {JOBS_OF_TRIES}").alias("jobs"), "job_id", *processor.names, "ts", F.unix_millis("ts").alias("ms"))
    out = rows.groupBy("jobs").transformWithState(processor, TRIES, "Append", "EventTime")
    return out.select("job_id", "attempt", F.timestamp_millis("ms").alias("at"), "status", F.timestamp_millis("next_ms").alias("next_run"))


def limited_stream(requests: DataFrame, most: int, seconds: int, late: str = "0 seconds") -> DataFrame:
    """When each request of a stream (key, id, ts) is let through."""
    rows = requests.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts")).groupBy("key")
    out = rows.transformWithState(SlidingLimit(most, seconds), ADMITTED, "Append", "EventTime")
    return out.select("key", "id", F.timestamp_millis("ms").alias("ts"), F.timestamp_millis("admitted_ms").alias("admitted"))


def limited_batch(requests: DataFrame, most: int, seconds: int) -> DataFrame:
    """(key, id, ts, admitted): as of the stream, without a loop.

    A request waits for the one ``most`` places before it, so requests of equal place modulo ``most`` form chains, and the
    wait is the largest that any earlier one of the chain hands on.
    """
    rows = requests.withColumns({"ms": F.unix_millis("ts"), "n": F.row_number().over(Window.partitionBy("key").orderBy("ts", "id")) - 1})
    step = F.expr(f"n div {most}") * seconds * 1_000
    chain = Window.partitionBy("key", F.col("n") % most).orderBy("n")
    return rows.select("key", "id", "ts", F.timestamp_millis((F.max(F.col("ms") - step).over(chain) + step).cast("long")).alias("admitted"))


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB while the body runs; what was set before is set again."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def replayed(rows: DataFrame, work: Callable[[DataFrame], DataFrame], label: str, slices: int = 3) -> DataFrame:
    """What ``work`` puts out for ``rows`` as a stream: files of ``slices`` spans of ``ts`` come one after the other, and the stream
    is stopped and restarted from its checkpoint before each of them."""
    spark, folder = rows.sparkSession, scratch(rows.sparkSession, label)
    ends = rows.select(F.unix_micros("ts").alias("at")).stat.approxQuantile("at", [k / slices for k in range(1, slices)], 0.001) if slices > 1 else []
    at = F.unix_micros("ts")
    spans = list(zip([None, *ends], [*ends, None], strict=True))
    with rocks(spark):
        for k, (low, high) in enumerate(spans):
            part = rows if low is None else rows.where(at > low)
            (part if high is None else part.where(at <= high)).write.parquet(f"{folder}/in/{k}")
            out = work(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*"))
            drain(out, lambda df, number: df.write.mode("overwrite").parquet(f"{folder}/out/batch={number}"), f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select(*out.columns)


# --- queries ---
_STATE = "CASE event_type WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END"
STALE, DELAY, MOST = 200_000, 40_000, 3
ITEMS_SQL = f"""c AS (SELECT user_id AS job_id, event_id % 3 AS item_id, {_STATE} AS state, epoch_us(ts) // 1000 AS ms, ts, event_id AS id FROM events), u AS (SELECT max(ms) AS until_ FROM c),
r AS (SELECT *, ms + {STALE * 1000} AS due, lead(ms) OVER w AS next_, row_number() OVER (PARTITION BY job_id, item_id ORDER BY ts DESC, id DESC) = 1 AS last_ FROM c, u WINDOW w AS (PARTITION BY job_id, item_id ORDER BY ts, id)),
i AS (SELECT job_id, item_id, max(state) FILTER (last_) AS end_state, max(ms) FILTER (last_) AS end_ms, min(due) FILTER (state = 'processing' AND due <= until_ AND (next_ IS NULL OR next_ > due)) AS at_ FROM r GROUP BY ALL),
s AS (SELECT job_id, item_id, at_, CASE WHEN end_state = 'processing' AND at_ > end_ms THEN 'pending' ELSE end_state END AS state FROM i)"""


def _changes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), (F.col("event_id") % 3).alias("item_id"), F.expr(_STATE).alias("state"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))


PROGRESS_SQL = f"""WITH {ITEMS_SQL} SELECT job_id, count(*) AS items, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'processing') AS processing, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed,
round(100.0::DOUBLE * count(*) FILTER (state IN ('done', 'failed')) / count(*), 1) AS percent FROM s GROUP BY job_id"""
REQUEUED_SQL = f"""WITH {ITEMS_SQL} SELECT job_id, item_id, epoch_ms(at_) AS at FROM s WHERE at_ IS NOT NULL"""


@BOOK.add(PROGRESS_SQL)
def stm3_progress_state(spark, sf_dir):
    """Progress of each job from keyed state, over the events as a stream that is restarted twice."""
    out = replayed(_changes(spark, sf_dir), lambda s: progress_stream(s, STALE), "progress")
    return out.groupBy("job_id").agg(F.max_by(F.struct("items", *STATES, "percent"), "version").alias("p")).select("job_id", "p.*")


@BOOK.add(REQUEUED_SQL)
def stm4_requeued_state(spark, sf_dir):
    """Items queued again once, by timers, over the events as a stream that is restarted twice."""
    out = replayed(_changes(spark, sf_dir), lambda s: progress_stream(s, STALE), "requeued")
    return out.where("kind = 'requeued'").select("job_id", "item_id", F.col("at").cast("timestamp_ntz").alias("at"))


@BOOK.add(PROGRESS_SQL)
def stm3_progress_batch(spark, sf_dir):
    """The same progress as windows and two aggregates over a batch."""
    changes = _changes(spark, sf_dir)
    return progress_batch(changes, STALE, changes.agg(F.unix_millis(F.max("ts")).alias("until")))[0]


@BOOK.add(REQUEUED_SQL)
def stm4_requeued_batch(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    out = progress_batch(changes, STALE, changes.agg(F.unix_millis(F.max("ts")).alias("until")))[1]
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


@BOOK.add(f"""WITH j AS (SELECT event_id AS job_id, ts, event_id % 5 AS fails FROM events), u AS (SELECT max(epoch_us(ts) // 1000) AS until_ FROM j),
k AS (SELECT job_id, fails, unnest(range(1, least(fails + 1, {MOST}) + 1)) AS attempt, epoch_us(ts) // 1000 AS ms FROM j),
t AS (SELECT job_id, fails, attempt, ms + {DELAY * 1000} * (CAST(pow(2, attempt - 1) AS BIGINT) - 1) AS ms FROM k)
SELECT job_id, CAST(attempt AS INTEGER) AS attempt, epoch_ms(ms) AS at, CASE WHEN attempt > fails THEN 'done' WHEN attempt = {MOST} THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN attempt <= fails AND attempt < {MOST} THEN epoch_ms(ms + {DELAY * 1000} * CAST(pow(2, attempt - 1) AS BIGINT)) END AS next_run FROM t, u WHERE attempt = 1 OR ms <= until_""")
def stm7_tries(spark, sf_dir):
    """Tries of jobs with a wait that doubles, by timers; what is due after the last event has not come yet."""
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 5).alias("fails"))
    out = replayed(jobs, lambda s: tries_stream(s, lambda job, attempt: attempt <= job["fails"], "fails long", DELAY, MOST, 2), "tries")
    return out.withColumns({"at": F.col("at").cast("timestamp_ntz"), "next_run": F.col("next_run").cast("timestamp_ntz")})


LIMIT_SQL = """WITH r AS (SELECT user_id % 20 AS key, event_id AS id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) - 1 AS n FROM events)
SELECT key, id, epoch_ms(max(ms - (n // 4) * 90000000) OVER (PARTITION BY key, n % 4 ORDER BY n) + (n // 4) * 90000000) AS admitted FROM r"""


def _requests(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))


@BOOK.add(LIMIT_SQL)
def stm5_sliding_limit(spark, sf_dir):
    """When each request is let through, four in 25 hours, from list state."""
    out = replayed(_requests(spark, sf_dir), lambda s: limited_stream(s, 4, 90_000), "limit")
    return out.select("key", "id", F.col("admitted").cast("timestamp_ntz").alias("admitted"))


@BOOK.add(LIMIT_SQL)
def stm5_sliding_limit_batch(spark, sf_dir):
    """The same as a window over chains of requests."""
    return limited_batch(_requests(spark, sf_dir), 4, 90_000).select("key", "id", F.col("admitted").cast("timestamp_ntz").alias("admitted"))
