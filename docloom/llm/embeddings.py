"""Operator 9, embedding near-dedup: epsilon grid order join.

Unit vectors with a cosine of at least ``threshold`` lie at most epsilon = sqrt(2 - 2 * threshold) apart, and no further
in any projection. Vectors are projected on the leading principal axes, as many as hold most of the variance, and put into
the order of their grid cells of width epsilon, within each label. The sequence is cut into blocks of bounded size. Pairs of
intervals of the sequence are joined recursively: an interval of blocks has a bounding box, pairs whose boxes lie further
apart than epsilon on some axis are skipped, the others are split into their parts, down to pairs of blocks. A task takes a
block with a few of its partners, so a block is shipped once for several pairs, and joins them by halving both sequences
again and again, skipping distant halves, down to short intervals whose cosines are computed in full.

Equal vectors are one from the start, with their count. Tasks report the number of links of each vector and links that
join them into trees, never all pairs, so a dense cell costs time but no output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .shared import components, cut

THRESHOLD, BLOCK_ROWS, LEAF_ROWS = 0.98, 4_000, 128
#: Most axes and the share of the variance they are to hold, parts of an interval, partners of a block in one task, rows sorted by one task.
MOST_AXES, VARIANCE, PARTS, PARTNERS, SORT_ROWS = 16, 0.8, 16, 8, 200_000


def _usable(vector: str) -> str:
    """SQL: not null, with finite components only and not zero."""
    return f"{vector} is not null and not exists({vector}, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists({vector}, x -> x <> 0)"


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class _Trees:
    def __init__(self, n: int):
        self.root, self.links = list(range(n)), []

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def link(self, i: int, j: int) -> None:
        x, y = self.find(i), self.find(j)
        if x != y:
            self.root[max(x, y)] = min(x, y)
            self.links.append((i, j))


def ego_join(unit: np.ndarray, axes: np.ndarray, counts: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each row and joining links, of rows in grid order; ``first`` marks rows of the first of two sequences.

    With rows of one sequence only (all marked) the sequence is joined with itself, else the first with the second.
    """
    eps = np.sqrt(2 - 2 * threshold) + 1e-9
    found, trees = np.zeros(len(unit), dtype=np.int64), _Trees(len(unit))
    cut_at = int(first.sum())
    halves = [(0, cut_at, 0, cut_at)] if cut_at == len(unit) else [(0, cut_at, cut_at, len(unit))]
    while halves:
        a, b, c, d = halves.pop()
        if a >= b or c >= d:
            continue
        own = (a, b) == (c, d)
        if not own and (np.maximum(axes[a:b].min(0) - axes[c:d].max(0), axes[c:d].min(0) - axes[a:b].max(0)) > eps).any():
            continue
        if max(b - a, d - c) > LEAF_ROWS:
            m, k = (a + b) // 2, (c + d) // 2
            halves += [(a, m, a, m), (a, m, m, b), (m, b, m, b)] if own else [(x, y, z, w) for x, y in ((a, m), (m, b)) for z, w in ((c, k), (k, d))]
            continue
        near = unit[a:b] @ unit[c:d].T >= threshold
        if own:
            np.fill_diagonal(near, False)
            found[a:b] += near @ counts[a:b]
            near = np.triu(near)
        else:
            found[a:b] += near @ counts[c:d]
            found[c:d] += near.T @ counts[a:b]
        while near.any():
            left, right = (np.array([trees.find(i) for i in range(*ends)]) for ends in ((a, b), (c, d)))
            near &= left[:, None] != right[None, :]  # what hangs together already needs no further link
            for i in np.flatnonzero(near.any(1)).tolist():
                trees.link(a + i, c + int(near[i].argmax()))
    return found, trees.links


def _blocks(rows: DataFrame, block_rows: int, n_axes: int, n_rows: int) -> DataFrame:
    """``rows`` in grid order with ``task``, ``part`` (a run of at most ``block_rows`` of one label in one partition) and ``place`` in the order."""
    schema = StructType([*rows.schema.fields, StructField("task", IntegerType()), StructField("part", IntegerType()), StructField("place", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, block, size, last, place = TaskContext.get().partitionId(), 0, 0, None, 0
        for batch in batches:
            names = []
            for label in batch.column(batch.schema.get_field_index("label")).to_pylist():
                if label != last or size == block_rows:
                    block, size, last = block + 1, 0, label
                size += 1
                names.append(block)
            more = [pa.array([task] * len(names), pa.int32()), pa.array(names, pa.int32()), pa.array(range(place, place + len(names)), pa.int64())]
            place += len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "task", "part", "place"])

    keys = ["label", *(F.floor(F.col("axes")[i] / F.col("eps")) for i in range(n_axes)), "vec"]
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // SORT_ROWS))
    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(number, schema)


def _near_blocks(blocks: DataFrame, n_axes: int, eps: float) -> DataFrame:
    """(label, a, b), a <= b: pairs of ``blocks`` (label, at, low0, high0, ...) whose boxes are near, by intervals of the sequence.

    From one interval for all blocks of a label down to single blocks; each step splits the intervals of the pairs that are
    left into ``PARTS`` and joins them by the interval they come from, so what is distant is skipped whole.
    """
    sides = [f"{n}{i}" for i in range(n_axes) for n in ("low", "high")]
    close = F.lit(True)
    for i in range(n_axes):
        close = close & (F.col(f"low{i}") - F.col(f"r_high{i}") <= eps + 1e-9) & (F.col(f"r_low{i}") - F.col(f"high{i}") <= eps + 1e-9)
    levels, last = 0, blocks.agg(F.max("at")).first()[0] or 0
    while PARTS**levels <= last:
        levels += 1
    pairs = blocks.select("label", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).distinct()
    for level in range(levels - 1, -1, -1):
        nodes = blocks.groupBy("label", F.expr(f"at div {PARTS**level}").alias("a")).agg(*((F.min if c.startswith("low") else F.max)(c).alias(c) for c in sides))
        nodes = nodes.withColumn("above_a", F.expr(f"a div {PARTS}"))
        others = nodes.select("label", F.col("a").alias("b"), F.col("above_a").alias("above_b"), *(F.col(c).alias(f"r_{c}") for c in sides))
        left = pairs.toDF("label", "above_a", "above_b").join(nodes, ["label", "above_a"])
        pairs = cut(left.join(others, ["label", "above_b"]).where((F.col("a") <= F.col("b")) & close).select("label", "a", "b"), "intervals")
    return pairs


def links(classes: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(counts, edges) of distinct usable vectors: (vec, found) and (a, b). ``classes`` has vec, label, vector, copies."""
    eps = float(np.sqrt(2 - 2 * threshold))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_unit(v.values.to_numpy(zero_copy_only=False)[None, :])[0] for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(rows, pa.list_(pa.float64()))], ["vec", "label", "copies", "unit"])

    units = cut(classes.select("vec", "label", "vector", "copies").mapInArrow(unit, "vec long, label string, copies long, unit array<double>"), "units")
    sizes = units.agg(F.min(F.size("unit")), F.max(F.size("unit")), F.count("*")).first()
    n_axes = 2
    rows = units.withColumn("axes", F.array(*(F.coalesce(F.try_element_at("unit", F.lit(i + 1)), F.lit(0.0)) for i in range(n_axes))))
    if sizes[2] > 1 and sizes[0] == sizes[1] > n_axes:  # else the first components are the axes: any projection is right
        vectors = units.withColumn("v", array_to_vector("unit"))
        fit = PCA(k=min(MOST_AXES, sizes[0]), inputCol="v", outputCol="p").fit(vectors)
        n_axes = max(n_axes, 1 + int((np.cumsum(fit.explainedVariance.toArray()) < VARIANCE).sum()))
        n_axes = min(n_axes, MOST_AXES, sizes[0])
        rows = fit.transform(vectors).withColumn("axes", F.slice(vector_to_array("p"), 1, n_axes)).drop("v", "p")
    rows = cut(_blocks(rows.withColumn("eps", F.lit(eps)), block_rows, n_axes, sizes[2]).drop("eps"), "blocks")

    boxes = rows.groupBy("label", "task", "part").agg(*(f(F.col("axes")[i]).alias(f"{n}{i}") for i in range(n_axes) for n, f in (("low", F.min), ("high", F.max))))
    at = F.row_number().over(Window.partitionBy("label").orderBy("task", "part")).cast("long") - 1
    boxes = cut(boxes.withColumn("at", at), "boxes")
    pairs = _near_blocks(boxes, n_axes, eps)
    # A block a meets its partners in groups of a few; the group gets a itself once, and each partner.
    pairs = cut(pairs.withColumn("group", F.expr(f"(row_number() over (partition by label, a order by b) - 1) div {PARTNERS}")), "pairs")
    itself = F.max(F.col("a") == F.col("b")).alias("with_itself")
    own = pairs.groupBy("label", "a", "group").agg(itself).select("label", "a", "group", F.col("a").alias("at"), "with_itself", F.lit(True).alias("own"))
    shipped = own.union(pairs.where("a <> b").select("label", "a", "group", F.col("b").alias("at"), F.lit(False), F.lit(False)))
    named = rows.join(boxes.select("label", "task", "part", "at"), ["label", "task", "part"])

    def join(part: pd.DataFrame) -> pd.DataFrame:
        own = part[part["own"].to_numpy(bool)].sort_values("place")
        vec, counts = own["vec"].to_numpy(), own["copies"].to_numpy()
        unit, axes = np.stack(own["unit"].to_numpy()), np.stack(own["axes"].to_numpy())
        out = [(np.empty(0, np.int64),) * 3]

        def meet(vecs, units, places, copies, first):
            found, edges = ego_join(units, places, copies, first, threshold)
            hit, ends = np.flatnonzero(found), np.array(edges, dtype=np.int64).reshape(-1, 2)
            out.append((np.concatenate([vecs[hit], vecs[ends[:, 0]]]), np.concatenate([vecs[hit], vecs[ends[:, 1]]]), np.concatenate([found[hit], np.zeros(len(ends), np.int64)])))

        if own["with_itself"].iloc[0]:
            meet(vec, unit, axes, counts, np.ones(len(vec), bool))
        for _, b in part[~part["own"].to_numpy(bool)].groupby("at", sort=True):
            b = b.sort_values("place")
            first = np.r_[np.ones(len(vec), bool), np.zeros(len(b), bool)]
            meet(np.r_[vec, b["vec"].to_numpy()], np.vstack([unit, np.stack(b["unit"].to_numpy())]), np.vstack([axes, np.stack(b["axes"].to_numpy())]), np.r_[counts, b["copies"].to_numpy()], first)
        return pd.DataFrame(dict(zip(("a", "b", "found"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    sent = named.select("label", "at", "place", "vec", "copies", "unit", "axes").join(shipped, ["label", "at"])
    out = cut(sent.groupBy("label", "a", "group").applyInPandas(join, "a long, b long, found long"), "links")
    return out.where("found > 0").groupBy(F.col("a").alias("vec")).agg(F.sum("found").alias("found")), out.where("found = 0").select("a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``; only rows with equal labels are compared.

    Rows whose label is null or whose vector is null, zero or not finite have no links. Equal vectors count as links of
    each other. Vectors of unequal length in one label never link. Rows with null ids link, too, and name no component.
    Repeated ids are separate rows, an empty table gives no rows, other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = F.expr(f"label is not null and {_usable('vector')}")
    # A digest stands for label and vector wherever rows meet again; only the join of blocks carries vectors.
    said = F.sha2(F.concat(F.col("vector").cast("string"), F.lit("/"), "label"), 256)
    rows = rows.withColumn("key", F.when(usable, F.unhex(F.substring(said, 1, 32))))
    classes = rows.where("key is not null").groupBy("key").agg(F.any_value("label").alias("label"), F.any_value("vector").alias("vector"), F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("vec", F.monotonically_increasing_id()), "classes")
    found, edges = links(classes.withColumn("label", F.concat_ws("/", F.size("vector").cast("string"), "label")), threshold, block_rows)
    comps = components(edges).withColumnRenamed("node", "vec")
    named = classes.select("key", "vec", "least", "copies").join(comps, "vec", "left").withColumn("root", F.coalesce("component", "vec")).join(found, "vec", "left")
    named = cut(named.select("key", "root", "least", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    result = rows.select("id", "key").join(named.join(least, "root").select("key", "n_links", "component_id"), "key", "left")
    component = F.coalesce("component_id", "id")
    return result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op9_embeddings": op9_embeddings}
ORACLE_SQL = {
    "op9_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_sum(list_transform(e, lambda x: x * x)) > 0),
pair AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, p.y FROM reach r JOIN pair p ON r.y = p.x),
comp AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM pair GROUP BY x)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)"""
}
