import json

from docloom.sources import files
from docloom.streaming import events
from pyspark.sql import functions as F

AT = "/root/testdata/sf0.001"


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = spark.read.parquet(f"{AT}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = []
    events.drain(events.tumbling(stream, "1 day", "40 days"), lambda df, _: out.append(df.collect()), f"{tmp_path}/c", "update").awaitTermination()
    last = {(r.start, r.event_type): r.n for batch in out for r in batch}
    assert last == {(r.start, r.event_type): r.n for r in events.tumbling(rows, "1 day").collect()}


def test_queue_skips_bad_messages_and_restarts(spark, tmp_path):
    (tmp_path / "q").mkdir()
    good = [{"task_type": "parse", "job_id": j, "ts": "2024-01-01T00:00:00Z"} for j in "aab"]
    (tmp_path / "q/1.json").write_text("\n".join([*map(json.dumps, good), "{bad", json.dumps({"task_type": "other", "job_id": "c"}), json.dumps({"task_type": "parse"})]))
    seen = []
    run = lambda: events.drain(events.once_each(events.queue(spark, f"{tmp_path}/q", ["parse"])), lambda df, _: seen.extend(r.job_id for r in df.collect()), f"{tmp_path}/c").awaitTermination()
    run()
    run()
    assert sorted(seen) == ["a", "b"]


def test_text_files(spark, tmp_path):
    for name, data in {"a": "héllo \n".encode(), "b": "h\xe9llo".encode("latin-1"), "c": b" \n", "d": b"x\x00y"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path[-1]: (r.text, r.error) for r in files.read_text(spark, str(tmp_path)).collect()}
    assert got == {"a": ("héllo", None), "b": ("héllo", None), "c": (None, "empty"), "d": (None, "binary")}


def test_file_kinds(spark):
    rows = {b"%PDF-1.7": "pdf", b"PK\x03\x04x": "zip", b"\xff\xd8\xffx": "jpeg", b"RIFF1234WEBP": "webp", b"RIFF1234AVI ": "avi", b"1234ftypmp42": "mp4", b"MZ..": "exe", b"plain": "text", b"a\x01b": "unknown", b"": "empty"}
    df = spark.createDataFrame([(bytearray(k),) for k in rows], "c binary")
    assert {bytes(r.c): r.k for r in df.select("c", files.file_kind(F.col("c")).alias("k")).collect()} == rows


def test_coordinates_and_exports(spark, tmp_path):
    (tmp_path / "x.csv").write_text("series_name,Time (s),Value,y_unit\na,1,2.5,mV\nb,bad,1,mV\nc,3,4,\n")
    got = [(r.x, r.y, r.x_label, r.x_unit, r.y_unit, r.series) for r in files.read_coordinates(spark, f"{tmp_path}/x.csv").collect()]
    assert got == [(1.0, 2.5, "Time", "s", "mV", "a"), (3.0, 4.0, "Time", "s", "", "c")]
    df = spark.createDataFrame([(1, None, 2.0), (2, "b", 0.1234567)], "id int, name string, v double")
    files.write_csv(df.coalesce(1), f"{tmp_path}/csv")
    assert next((tmp_path / "csv").glob("*.csv")).read_text() == "id,name,v\n1,,2\n2,b,0.123457\n"
    files.write_json(df.coalesce(1), f"{tmp_path}/json")
    assert json.loads(next((tmp_path / "json").glob("*.json")).read_text().splitlines()[0]) == {"id": 1, "name": None, "v": 2.0}
    assert files.filled_first(df.select(F.lit(" ").alias("e"), "name", "id"), ["e", "name"]).columns == ["name", "e", "id"]
    assert [r.value for r in files.markdown_report(df, "name", "name", "id").collect()] == ["## untitled\n\n\n", "## b\n\nb\n"]
