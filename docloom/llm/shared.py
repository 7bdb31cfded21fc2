"""What the operators of this subpackage share: tables in the cluster's shared folder and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for local sessions without spark.checkpoint.dir, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/docloom"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that the driver and all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = FALLBACK_DIR
    return f"{folder.rstrip('/')}/docloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget_all(spark: SparkSession) -> None:
    """Delete every table this application has cut, once its results are written elsewhere; results not yet written need them."""
    _delete(spark, shared_dir(spark))


def text_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let Arrow batches hold at most so many rows from here on: rows with whole texts are long, and a batch is in memory at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread of files, never the work that made them, and every later
    reader sees the same rows even where the plan has an order that is not fixed.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing reads any more."""
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def _settled(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", "a"))).first())


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge (columns a, b).

    Alternating large-star and small-star steps; each moves every edge towards the smallest neighbour, so the rounds
    grow with the logarithm of a component's size. The minima are aggregated before they are joined back, and the joins
    stay plain sort-merge joins that adaptive execution splits where one node has very many edges. Every round is
    written to the shared folder. Self loops are ignored; no edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = cut(pairs, "edges")
    state = _settled(pairs)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = pairs.union(pairs.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        made = cut(small.where("a <> b").distinct(), "edges")
        forget(pairs)
        pairs, before = made, state
        state = _settled(pairs)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pairs.select("b", F.col("b").alias("c")).distinct()
    )
