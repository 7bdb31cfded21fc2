"""Exact nearest vectors by an index of cells: centroids with radii, pruned by the triangle inequality.

Unit vectors are dealt to the nearest of a fixed number of centroids. A query is at least its distance to the centroid less
the cell's radius away from any vector of a cell. The nearest cells that together hold k vectors give a first k-th
distance; then only cells that can hold something as near are read. The result is that of a scan of all vectors.

A cell meets its queries in blocks of bounded size, each as one product of matrices; what comes near the k-th place is
scored again component by component, so that equal vectors have equal scores wherever they stand.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import numbers
from docloom.plans.book import Book, scratch, table, written

BOOK = Book()
#: Cells, vectors that centroids are fitted on (the index holds all), rounds of the fit, and room for rounding.
CELLS, FIT_ROWS, ROUNDS, ROOM = 64, 20_000, 10, 1e-6
#: Vectors of a block on average, queries of one product, and how far a product may be from the score summed in order.
BLOCK, AT_ONCE, SLACK = 8_000, 256, 1e-9


def _unit(vector: str) -> Column:
    """The vector at length 1; its length is bound once, not taken again for every component."""
    length = F.array(F.sqrt(numbers.dot(F.col(vector), F.col(vector))))
    return F.transform(length, lambda n: F.transform(vector, lambda x: x.cast("double") / n))[0]


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first component to the last as ``numbers.dot`` does."""
    return np.cumsum(a * b, axis=1)[:, -1]


def _block_best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query, vec_id, score): the k best of a block for each query."""
    found = []
    if len(queries) and len(vectors):
        ids, own = vectors["vec_id"].to_numpy(), np.stack(vectors["embedding"].to_numpy()).astype(np.float64)
        lengths = np.sqrt(_in_order(own, own))
        units = (own / lengths[:, None]).T
        for at in range(0, len(queries), AT_ONCE):
            part = queries.iloc[at : at + AT_ONCE]
            asked = np.stack(part["unit"].to_numpy()).astype(np.float64)
            for key, q, near in zip(part["query"], asked, asked @ units, strict=True):
                least = np.partition(near, -k)[-k] if len(near) > k else -np.inf
                some = np.flatnonzero(near >= least - SLACK)
                score = _in_order(own[some], q[None, :]) / (lengths[some] * np.sqrt(_in_order(q[None, :], q[None, :])))
                best = np.lexsort((ids[some], -score))[:k]
                found.append(pd.DataFrame({"query": key, "vec_id": ids[some][best], "score": score[best]}))
    return pd.concat(found) if found else pd.DataFrame({"query": [], "vec_id": [], "score": []})


class VectorIndex:
    """An index that was written to ``path``; ``build`` makes one, the constructor opens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.cells, self.vectors = spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/vectors")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int = CELLS, id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
        """Index all ``vectors`` of one length that are not zero; null ones and ones with components that are null or not finite are left out, as they are near to nothing."""
        spark = vectors.sparkSession
        rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding")).where("embedding is not null")
        squares = numbers.dot(F.col("embedding"), F.col("embedding"))
        rows = rows.where((squares > 0) & (squares < float("inf"))).withColumn("unit", _unit("embedding"))
        fitted = rows.withColumn("v", array_to_vector("unit"))
        n = rows.count()
        sample = fitted.sample(min(1.0, FIT_ROWS / max(n, 1)), 7) if n > FIT_ROWS else fitted
        # The fit wants fewer centroids than there are different vectors.
        most = rows.agg(F.approx_count_distinct(F.xxhash64("unit"))).first()[0] // 8
        if most < 2:
            placed = rows.withColumn("cell", F.lit(0))
        else:
            placed = KMeans(k=min(cells, most), seed=7, maxIter=ROUNDS, featuresCol="v", predictionCol="cell").fit(sample).transform(fitted).drop("v")
        placed.repartition("cell").sortWithinPartitions("cell", "vec_id").write.partitionBy("cell").parquet(f"{path}/vectors")
        held = spark.read.schema(placed.schema).parquet(f"{path}/vectors")
        parts = held.select("cell", F.posexplode("unit").alias("at", "x")).groupBy("cell", "at").agg(F.avg("x").alias("x"))
        centroids = parts.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centroid"))
        # A centroid is a mean and no unit vector: distances to it are plain Euclidean ones.
        far = held.join(F.broadcast(centroids), "cell").groupBy("cell").agg(F.max(_distance("unit", "centroid")).alias("radius"), F.count("*").alias("n"))
        centroids.join(far, "cell").coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path)

    def visits(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(first, all): the cells each of ``queries`` (query, unit) looks at to get its first k, and all it must look at."""
        near = queries.crossJoin(F.broadcast(self.cells)).select("query", "unit", "cell", "n", "radius", _distance("unit", "centroid").alias("away"))
        near = written(near, "away")  # read three times
        before = F.sum("n").over(Window.partitionBy("query").orderBy("away", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        first = near.withColumn("before", before).where(F.col("before") < k).select("query", "unit", "cell")
        apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score")))
        reach = self._best(first, k).groupBy("query").agg(F.when(F.count("*") == k, apart).otherwise(F.lit(float("inf"))).alias("reach"))
        return first, near.join(reach, "query").where(F.col("away") - F.col("radius") <= F.col("reach") + ROOM).select("query", "unit", "cell")

    def _best(self, pairs: DataFrame, k: int) -> DataFrame:
        ids = dict(pairs.dtypes)["query"], dict(self.vectors.dtypes)["vec_id"]
        parts = self.cells.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        asked = pairs.join(F.broadcast(parts), "cell").select("query", "unit", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        held = self.vectors.join(F.broadcast(parts), "cell").select("vec_id", "embedding", "cell", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"))
        both = asked.groupBy("cell", "block").cogroup(held.groupBy("cell", "block"))
        met = both.applyInPandas(lambda q, v: _block_best(q, v, k), f"query {ids[0]}, vec_id {ids[1]}, score double")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        return met.withColumn("place", place).where(F.col("place") <= k)

    def nearest(self, queries: DataFrame, k: int, least: float = 0.0) -> DataFrame:
        """(query, place, vec_id, score): for each of ``queries`` (query, q) the k vectors nearest by cosine, above ``least``.

        Ties go to the smaller id. Queries that are null or zero have no neighbours.
        """
        own = queries.where(numbers.dot(F.col("q"), F.col("q")) > 0).select("query", _unit("q").alias("unit"))
        return self._best(self.visits(own, k)[1], k).where(F.col("score") > least).select("query", "place", "vec_id", "score")


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


# --- queries ---
def _index(spark, sf_dir) -> VectorIndex:
    return VectorIndex.build(table(spark, sf_dir, "embeddings"), scratch(spark, "vectors"))


@BOOK.add("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 3),
s AS (SELECT q.vec_id AS query, v.vec_id, list_cosine_similarity(v.e, q.e) AS score FROM v, q)
SELECT query, row_number() OVER w AS place, vec_id, round(score, 6) AS score FROM s WHERE score > 0 WINDOW w AS (PARTITION BY query ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""")
def ret2_vector_cells(spark, sf_dir):
    """Every fiftieth vector against all others, exactly, by cells."""
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 3").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return _index(spark, sf_dir).nearest(queries, 10).select("query", F.col("place").cast("long").alias("place"), "vec_id", F.round("score", 6).alias("score"))


@BOOK.add("""WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 3), c AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, d.text FROM embeddings JOIN documents d ON d.doc_id = vec_id)
SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS score FROM c, q WHERE list_cosine_similarity(e, q) > 0 ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 12""")
def ret4_semantic_cells(spark, sf_dir):
    """The chunks with a text that are nearest to one query, by cells (also SRT-6)."""
    vectors = table(spark, sf_dir, "embeddings")
    chunks = vectors.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id")
    index = VectorIndex.build(chunks, scratch(spark, "vectors"))
    return index.nearest(vectors.where("vec_id = 3").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), 12).select("vec_id", F.round("score", 6).alias("score"))
