"""Operator 1, sharding: proportional stratified interleaving.

Rows are put in a seeded random order within each stratum, every row gets its fractional rank in that order, and the
rows of all strata are merged by fractional rank. A stratum's ranks start at a seeded phase between 0 and 1 instead of all
at one half, so strata of equal sizes share no fractions: any number of strata of one row each is spread over the shards. Any run of consecutive rows of the merged order holds every stratum
in the proportion it has in the whole table, so equal cuts of it are shards with equal counts and equal mixtures.

No global sort and no task per stratum: both rankings go through buckets of a value that is spread evenly (the
shuffle key, then the fractional rank), so that a stratum with a third of all rows is dealt over as many tasks as its
rows need. A row's rank is its row number in its bucket plus the rows of the buckets before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut

#: Rows that a bucket holds on average.
BUCKET_ROWS = 500
#: Buckets whose counts are summed up in one task; the sums of such runs are summed up first.
RUN_BUCKETS = 4_096


def _before(rows: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """(keys, bucket, before): the rows in all smaller buckets, summed up in two levels so that no task has all buckets."""
    each = rows.groupBy(*keys, bucket).count().withColumn("run", F.expr(f"{bucket} div {RUN_BUCKETS}"))
    runs = each.groupBy(*keys, "run").agg(F.sum("count").alias("all"))
    ahead = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.select(*keys, "run", (F.sum("all").over(ahead) - F.col("all")).alias("base"))
    within = Window.partitionBy(*keys, "run").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("own", F.sum("count").over(within) - F.col("count"))
    return each.join(runs, [*keys, "run"]).select(*keys, bucket, (F.col("base") + F.col("own")).alias("before"))


def _hashed(*parts) -> Column:
    return F.md5(F.concat(*parts))


def fractions(docs: DataFrame, stratum: str, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, stratum, size, crc, key, fraction, span) of every row, written once, and the number of rows; a span is an equal part of all fractions."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        _hashed(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"),
    )
    slim = cut(slim, "rows")  # counted and ranked from one copy, whatever the source gives when it is read again
    n = slim.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    slim = slim.withColumn("bucket", F.expr(f"cast(conv(substr(key, 1, 8), 16, 10) as long) * {buckets} div {16**8}"))
    order = ["key", "id", "crc", "size"]
    phase = F.conv(F.substring(_hashed(F.lit(f"{seed}/"), "stratum"), 1, 8), 16, 10).cast("double") / 16**8
    totals = slim.groupBy("stratum").agg(F.count("*").alias("total"))
    ranked = (
        slim.withColumn("rank", F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*order)))
        .join(_before(slim, ["stratum"], "bucket"), ["stratum", "bucket"]).join(totals, "stratum")
        .withColumn("fraction", (F.col("rank") + F.col("before") - 1 + phase) / F.col("total"))
        .withColumn("span", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)))
    )
    return cut(ranked.select("id", "stratum", "size", "crc", "key", "fraction", "span"), "interleave"), n


def interleave(docs: DataFrame, n_shards: int, stratum: str = "source", seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``; the law is ``rows``.

    ``size`` is the UTF-8 length of the text plus 16. Null texts count as empty ones, null strata are a stratum of their
    own, rows with equal or null ids are separate rows, and an empty table gives no rows. Other columns are ignored.
    With fewer rows than shards some shards are empty. Equal texts have no bond: the law ``rows`` (counts at most one
    apart) could not hold with a group of equal texts larger than a shard in one place.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    ranked, n = fractions(docs, stratum, seed, id_col, text_col)
    order = ["key", "id", "crc", "size"]
    spans = _before(ranked.select("span", F.lit(0).alias("whole")), ["whole"], "span").drop("whole")
    place = F.row_number().over(Window.partitionBy("span").orderBy("fraction", "stratum", *order)) + F.col("before") - 1
    return (
        ranked.join(spans, "span")
        .withColumn("place", place)
        .withColumn("shard", F.expr(f"place * {n_shards} div {max(n, 1)}").cast("int"))
        .select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
            F.expr(f"place - (shard::long * {n} + {n_shards - 1}) div {n_shards}").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op1_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)


QUERIES = {"op1_interleave": op1_interleave}
ORACLE_SQL: dict[str, str] = {}
