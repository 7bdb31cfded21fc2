"""Keyed state: what streams put out does not depend on restarts, and equals the batch twins."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from docloom.streaming import keyed as op


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


CHANGES = [
    (1, 1, "pending", 0, 1), (1, 1, "processing", 10, 2), (1, 2, "processing", 12, 3), (1, 2, "done", 40, 4), (1, 3, "processing", 20, 5), (1, 3, "processing", 60, 6), (2, 1, "failed", 5, 7),
    (2, 2, "processing", 30, 8), (2, 2, "processing", 130, 9), (1, 1, "done", 200, 10), (3, 1, "processing", 210, 11), (2, 2, "processing", 400, 12), (1, 9, "pending", 900, 13),
]


@pytest.mark.parametrize("slices", [1, 4])
def test_progress_and_requeue(spark, slices):
    """Item 1/1 and 3/1 wait again, 2/2 only once, 1/2 and 1/3 moved in time or are due once by their last change."""
    rows = spark.createDataFrame([(j, i, s, at(t), k) for j, i, s, t, k in CHANGES], "job_id long, item_id long, state string, ts timestamp, id long")
    out = op.replayed(rows, lambda s: op.progress_stream(s, 50), "test", slices).collect()
    queued = {(r.job_id, r.item_id, (r.at - at(0)).total_seconds()) for r in out if r.kind == "requeued"}
    assert queued == {(1, 1, 60), (1, 3, 110), (2, 2, 80), (3, 1, 260)}
    last = {r.job_id: (r["items"], r.pending, r.processing, r.done, r.failed) for r in sorted(out, key=lambda r: r.version)}
    assert last == {1: (4, 2, 0, 2, 0), 2: (2, 0, 1, 0, 1), 3: (1, 1, 0, 0, 0)}
    progress, requeued = op.progress_batch(rows, 50, rows.agg(F.unix_millis(F.max("ts")).alias("until")))
    assert {(r.job_id, r.item_id, (r.at - at(0)).total_seconds()) for r in requeued.collect()} == queued
    assert {r.job_id: (r["items"], r.pending, r.processing, r.done, r.failed) for r in progress.collect()} == last


def test_tries_catch_up_and_repeated_jobs(spark):
    rows = spark.createDataFrame([(1, at(0), 0), (2, at(1), 1), (3, at(2), 9), (2, at(50), 9), (4, at(1_000), 1)], "job_id long, ts timestamp, fails long")
    out = op.replayed(rows, lambda s: op.tries_stream(s, lambda job, n: n <= job["fails"], "fails long", 10, 3, 2), "test", 2).collect()
    seconds = lambda t: None if t is None else (t - at(0)).total_seconds()
    got = sorted((r.job_id, r.attempt, seconds(r.at), r.status, seconds(r.next_run)) for r in out)
    assert got == [(1, 1, 0, "done", None), (2, 1, 1, "pending", 11), (2, 2, 11, "done", None), (3, 1, 2, "pending", 12), (3, 2, 12, "pending", 32), (3, 3, 32, "failed", None), (4, 1, 1_000, "pending", 1_010)]


def test_sliding_limit(spark):
    rows = spark.createDataFrame([(k % 2, k, at(t)) for k, t in enumerate([0, 0, 1, 1, 2, 2, 3, 70, 71, 80, 80, 81, 300])], "key long, id long, ts timestamp")
    stream = {(r.key, r.id): r.admitted for r in op.replayed(rows, lambda s: op.limited_stream(s, 2, 60), "test", 3).collect()}
    assert stream == {(r.key, r.id): r.admitted for r in op.limited_batch(rows, 2, 60).collect()}
    for key in (0, 1):  # never more than two within 60 seconds, and nobody waits longer than that asks
        times = sorted(t for (k, _), t in stream.items() if k == key)
        assert all((c - a).total_seconds() >= 60 for a, c in zip(times, times[2:], strict=False))
    assert stream[0, 4] == at(60) and stream[0, 12] == at(300)


@pytest.mark.parametrize("work", ["tries", "progress"])
def test_jobs_share_calls_and_timers(spark, tmp_path, work):
    """1,600 waiting jobs in few runs of ids: a timer and a call for a run, not for each job."""
    rows = spark.range(1_600).selectExpr("id AS job_id", "id % 3 AS item_id", "'processing' AS state", "timestamp_seconds(1700000000 + id % 7) AS ts", "id", "id % 4 AS fails")
    rows.write.parquet(f"{tmp_path}/in")
    streams = {"tries": lambda s: op.tries_stream(s, lambda job, n: n <= job["fails"], "fails long", 10, 3, 2), "progress": lambda s: op.progress_stream(s, 50)}
    with op.rocks(spark):
        query = op.drain(streams[work](spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")), lambda df, k: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={k}"), f"{tmp_path}/c")
        query.awaitTermination()
    timers = sum(int(o["customMetrics"]["numRegisteredTimers"]) for p in map(json.loads, (p.json for p in query.recentProgress)) for o in p["stateOperators"])
    assert spark.read.parquet(f"{tmp_path}/out").select("job_id").distinct().count() == 1_600 and 0 < timers <= 100
