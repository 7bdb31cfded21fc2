"""Progress of batches and streams: counts that Spark takes while it works, as rows.

``observe`` adds aggregates to a plan that are computed on the way, without another pass. A batch hands them out when its
action is done; a stream reports them with every micro-batch to a listener, which keeps one row for each.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from docloom.plans.book import Book, table
from docloom.streaming.keyed import replayed

BOOK = Book()
ROWS = "run string, batch long, name string, value long"


def counted(of: DataFrame, /, **counts: Column) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """The rows ``of`` a table and a function that gives the ``counts`` once an action on them is done."""
    seen = Observation("counted")
    return of.observe(seen, *(c.alias(name) for name, c in counts.items())), lambda: dict(seen.get)


class ProgressListener(StreamingQueryListener):
    """Rows (run, batch, name, value) of what streams observe under ``label``: one for each count of each batch that had rows.

    ``told`` is called with each batch's counts, as a caller's progress bar. Events come some time after the batch; ``rows``
    waits for the end of all runs that have started.
    """

    def __init__(self, label: str, told: Callable[[int, dict[str, int]], None] | None = None):
        self.label, self.told, self.started, self.ended, self.seen = label, told, set(), set(), {}

    def onQueryStarted(self, event) -> None:
        self.started.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        counts = event.progress.observedMetrics.get(self.label)
        if counts is not None and event.progress.numInputRows:
            self.seen[str(event.progress.runId), event.progress.batchId] = counts.asDict()
            if self.told:
                self.told(event.progress.batchId, counts.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def rows(self, runs: int = 1, patience: float = 30.0) -> list[tuple[str, int, str, int]]:
        until = time.monotonic() + patience
        while time.monotonic() < until and (len(self.ended) < runs or self.started - self.ended):
            time.sleep(0.05)
        return [(run, batch, name, value) for (run, batch), counts in sorted(self.seen.items(), key=lambda s: s[0][1]) for name, value in sorted(counts.items())]


def observed_stream(stream: DataFrame, label: str, /, **counts: Column) -> DataFrame:
    """A stream whose batches report ``counts`` under ``label``."""
    return stream.observe(label, *(c.alias(name) for name, c in counts.items()))


@BOOK.add("""SELECT 3::BIGINT AS batches, 'errors' AS name, count(*) FILTER (event_type = 'error') AS value FROM events UNION ALL SELECT 3, 'rows', count(*) FROM events UNION ALL SELECT 3, 'users', max(user_id) FROM events""")
def udf7_stream_progress(spark, sf_dir):
    """Counts that three micro-batches of a restarted stream have reported, added up."""
    label, listener = "work", ProgressListener("work")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    counts = {"rows": F.count("*"), "errors": F.count_if(F.col("event_type") == "error"), "users": F.max("user_id").cast("long")}
    spark.streams.addListener(listener)
    try:
        replayed(events, lambda s: observed_stream(s, label, **counts).select("event_id"), "observed", 3)
        rows = listener.rows(3)
    finally:
        spark.streams.removeListener(listener)
    told = spark.createDataFrame(rows, ROWS)
    value = F.when(F.col("name") == "users", F.max("value")).otherwise(F.sum("value"))
    return told.groupBy("name").agg(F.countDistinct("batch").alias("batches"), value.alias("value"))


@BOOK.add("""SELECT count(*) AS rows, count(*) FILTER (text = '') AS empty, sum(length(text))::BIGINT AS chars FROM documents""")
def udf7_batch_progress(spark, sf_dir):
    """Counts taken while the documents are hashed, in one pass."""
    docs = table(spark, sf_dir, "documents")
    rows, counts = counted(docs.select(F.sha2("text", 256).alias("h"), "text"), rows=F.count("*"), empty=F.count_if(F.col("text") == ""), chars=F.sum(F.length("text")).cast("long"))
    rows.select("h").write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([counts()], "rows long, empty long, chars long")
