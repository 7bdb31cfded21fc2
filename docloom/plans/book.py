"""A book of queries: each is a callable (spark, sf_dir) -> DataFrame and, where SQL can say it, DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its own name, with its SQL."""

        def put(function: Query) -> Query:
            self.queries[function.__name__] = function
            if sql is not None:
                self.sql[function.__name__] = sql
            return function

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the library."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sent(rows: DataFrame, most: int = 8_000_000) -> DataFrame:
    """``rows`` to be sent to every task if they hold at most ``most`` bytes as text; else as they are, to be joined by shuffle."""
    size = rows.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in rows.columns), F.lit(16)))).first()[0] or 0
    return F.broadcast(rows) if size <= most else rows


def text_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let Arrow batches hold at most so many rows from here on: rows with whole texts are long, and a batch is in memory at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the one that the driver and all executors share; only local sessions may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
    return f"{folder.rstrip('/')}/docloom-scratch-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written once to the shared folder and read back: cuts the lineage, and every reader sees the same rows."""
    path = scratch(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
