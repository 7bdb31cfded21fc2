"""Operator 11, approximate nearest neighbours: a robust-pruned directed graph for each shard.

Nearness is the largest inner product. One further component, the root of what a squared length lacks to the largest one
of the shard, makes it a Euclidean distance, in which the graph is built: nodes come in batches that double; a greedy
search from a few entry nodes proposes neighbours for each node of a batch; pruning keeps the nearest one left and drops all
that ``ALPHA`` times nearer to it than to the node, again and again, so that edges stay few and point in many directions;
edges are put in backwards, too, and lists that overflow are pruned likewise. Nodes that no path from an entry
reaches get an edge from the nearest one reached. Queries walk the graph of every shard with a beam, what they meet last
is scored in double precision on the original vectors, and the best of all shards are merged.

Equal vectors are one node, with their smallest ids: k results need no more than k + 1 of them (one may be the query's own
row), so a group of copies of any size is one node and loses no result. Shards are hashes of the vectors and hold
``SHARD_ROWS`` nodes; the index is a table with a row for each node, so that it can be kept and searched again. Queries meet
shards in blocks of ``QUERY_ROWS``; a task holds one shard and streams one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .embeddings import _usable
from .shared import cut

DEGREE, ALPHA, BUILD_BEAM, SEARCH_BEAM = 32, 1.2, 64, 192
#: Nodes that a walk starts from: the one nearest to the mean and others at random, as a crowd around the mean may lead nowhere else.
ENTRIES = 256
#: Nodes of a shard, distinct queries of a block, nodes that are put in at once, nodes that a step of the beam opens.
SHARD_ROWS, QUERY_ROWS, BATCH, OPENED = 16_000, 20_000, 512, 4
#: Most numbers of candidates' vectors that pruning holds at once.
PRUNE_CELLS = 6_000_000


def beam_search(x: np.ndarray, squares: np.ndarray, links: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, distances, opened) for each query: the ``beam`` nearest nodes met, nearest first (-1: none), and all nodes opened.

    A node's distance is its square less twice the inner product: the Euclidean distance but for a constant of the query.
    """
    n, rows = len(queries), np.arange(len(queries))[:, None]
    ids, dist, done = np.full((n, beam), -1), np.full((n, beam), np.inf, np.float32), np.ones((n, beam), bool)
    start = squares[entries] - 2 * (queries @ x[entries].T)
    first = np.argsort(start, axis=1, kind="stable")[:, :beam]
    width = first.shape[1]
    ids[:, :width], dist[:, :width], done[:, :width] = entries[first], np.take_along_axis(start, first, 1), False
    seen = np.zeros((n, len(x) + 1), bool)  # the last column stands for -1
    seen[:, entries] = True
    seen[:, -1] = True
    opened = []
    while True:
        live = np.flatnonzero(~done.all(1))
        if not len(live):
            return ids, dist, np.concatenate(opened, axis=1) if opened else ids[:, :0]
        at = np.argsort(done[live], axis=1, kind="stable")[:, :OPENED]  # the nearest that are not open yet come first
        some = np.where(np.take_along_axis(done[live], at, 1), -1, np.take_along_axis(ids[live], at, 1))
        done[live[:, None], at] = True
        record = np.full((n, at.shape[1]), -1)
        record[live] = some
        opened.append(record)
        near = np.where(some[:, :, None] >= 0, links[some], -1).reshape(len(live), -1)
        near = np.where(seen[live[:, None], near], -1, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[live[:, None], near] = True
        d = squares[near] - 2 * np.einsum("brd,bd->br", x[near], queries[live])
        d[near < 0] = np.inf
        all_ids, all_dist = np.concatenate([ids[live], near], 1), np.concatenate([dist[live], d], 1)
        all_done = np.concatenate([done[live], near < 0], 1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live], done[live] = (np.take_along_axis(v, best, 1) for v in (all_ids, all_dist, all_done))


def robust_prune(x: np.ndarray, squares: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` of each node's ``candidates`` (-1: none): the nearest left is kept and drops what is alpha times nearer to it."""
    kept = np.full((len(nodes), degree), -1)
    step = max(1, PRUNE_CELLS // (candidates.shape[1] * x.shape[1]))
    for low in range(0, len(nodes), step):
        own, node = candidates[low : low + step], nodes[low : low + step]
        own = np.sort(np.where(own == node[:, None], -1, own), axis=1)
        own[:, 1:][own[:, 1:] == own[:, :-1]] = -1
        vectors, rows = x[own], np.arange(len(own))
        far = squares[own] - 2 * np.einsum("bcd,bd->bc", vectors, x[node]) + squares[node][:, None]
        left = own >= 0
        for k in range(degree):
            pick = np.where(left, far, np.inf).argmin(1)
            good = left[rows, pick]
            if not good.any():
                break
            kept[low : low + step, k] = np.where(good, own[rows, pick], -1)
            between = squares[own] - 2 * np.einsum("bcd,bd->bc", vectors, vectors[rows, pick]) + squares[own[rows, pick]][:, None]
            left &= alpha * alpha * between > far
            left[rows, pick] = False
    return kept


def build_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(links, entries) of the rows of ``x``; links[i] are the nodes that i leads to, filled up with -1."""
    n, squares = len(x), np.einsum("nd,nd->n", x, x)
    links, order = np.full((n, degree), -1), np.random.default_rng(0).permutation(n)
    entries = np.unique(np.r_[int(((x - x.mean(0)) ** 2).sum(1).argmin()), order[: ENTRIES - 1]])
    low = 0
    while low < len(order):
        batch = order[low : low + min(BATCH, max(1, low))]
        low += len(batch)
        ids, _, opened = beam_search(x, squares, links, entries, x[batch], beam)
        links[batch] = robust_prune(x, squares, batch, np.concatenate([ids, opened], 1), degree, alpha)
        # Edges backwards: each target's new sources beside its old edges.
        source, target = np.repeat(batch, degree), links[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, (target, start, new) = source[by], np.unique(target[by], return_index=True, return_counts=True)
        old = (links[target] >= 0).sum(1)
        for wide in np.unique(np.ceil(np.log2(new)).astype(int)):  # lists of like lengths together
            some = np.flatnonzero(np.ceil(np.log2(new)).astype(int) == wide)
            more = np.full((len(some), new[some].max()), -1)
            for i, t in enumerate(some):
                more[i, : new[t]] = source[start[t] : start[t] + new[t]]
            both = np.concatenate([links[target[some]], more], 1)
            fits = old[some] + new[some] <= degree
            links[target[some[fits]]] = -np.sort(-both[fits], axis=1)[:, :degree]
            if not fits.all():
                links[target[some[~fits]]] = robust_prune(x, squares, target[some[~fits]], both[~fits], degree, alpha)
    while True:
        reached, front = np.zeros(n + 1, bool), entries
        while len(front):
            reached[front] = True
            front = np.unique(links[front])
            front = front[(front >= 0) & ~reached[front]]
        lost = np.flatnonzero(~reached[:n])
        if not len(lost):
            return links, entries
        nearest = np.concatenate([beam_search(x, squares, links, entries, x[lost[i : i + BATCH]], beam)[0][:, 0] for i in range(0, len(lost), BATCH)])
        for node, giver in zip(lost.tolist(), nearest.tolist(), strict=True):
            if not (links[giver] < 0).any():
                links = np.concatenate([links, np.full((n, 1), -1)], 1)
            links[giver, (links[giver] < 0).argmax()] = node


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """In single precision, scaled by the largest component so that no square overflows."""
    return (vectors / np.abs(vectors).max()).astype(np.float32)


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", copies: int = 21) -> DataFrame:
    """(key, dim, vector, members) of distinct usable vectors with their ``copies`` smallest ids."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(_usable("vector")).where("id is not null")
    rows = rows.withColumn("key", F.unhex(F.substring(F.sha2(F.col("vector").cast("string"), 256), 1, 32)))
    whole = rows.groupBy("key").agg(F.any_value("vector").alias("vector"))
    # Spark keeps the smallest rows of a key in each partition before it shuffles them.
    least = rows.select("key", "id", F.row_number().over(Window.partitionBy("key").orderBy("id")).alias("place")).where(F.col("place") <= copies)
    members = least.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("members"))
    return whole.join(members, "key").select("key", F.size("vector").alias("dim"), "vector", "members")


INDEX = "dim int, shard int, node int, key binary, vector array<double>, members array<long>, links array<int>, entry boolean"


def build_index(nodes: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM) -> DataFrame:
    """One row for each of ``nodes`` (as of ``classes``): shard, place in it, links and whether it is an entry of the shard; written once."""
    shards = max(1, -(-nodes.count() // shard_rows))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key").reset_index(drop=True)
        x = _scaled(np.stack(part["vector"].to_numpy()))
        squares = np.einsum("nd,nd->n", x, x)
        links, entries = build_graph(np.column_stack([x, np.sqrt(squares.max() - squares)]), degree, alpha, beam)
        part["node"], part["links"] = np.arange(len(part), dtype=np.int32), [row[row >= 0].astype(np.int32) for row in links]
        part["entry"] = part["node"].isin(entries)
        return part[["dim", "shard", "node", "key", "vector", "members", "links", "entry"]]

    sharded = nodes.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return cut(sharded.groupBy("dim", "shard").applyInPandas(build, INDEX), "index")


class _Shard:
    """The graph of one shard, from batches of index rows."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches)
        n = rows.num_rows
        self.keys, self.members = rows["key"].to_pylist(), rows["members"].to_pylist()
        self.vectors = _matrix(rows["vector"], n)
        lists = rows["links"].to_pylist()
        self.links = np.full((n, max(1, max(map(len, lists)))), -1)
        for i, own in enumerate(lists):
            self.links[i, : len(own)] = own
        self.entries = np.flatnonzero(rows["entry"].to_numpy())
        self.x = _scaled(self.vectors)

    def search(self, keys: list[bytes], queries: np.ndarray, k: int, beam: int) -> Iterator[tuple]:
        """(key, score, vec_id, same) of the ``k`` best rows met by each query."""
        length = np.abs(queries).max(axis=1, keepdims=True)
        # Inner products instead of distances: the squares are left out.
        ids, *_ = beam_search(self.x, np.zeros(len(self.x), np.float32), self.links, self.entries, (queries / length).astype(np.float32), max(beam, k))
        with np.errstate(over="ignore", invalid="ignore"):
            scores = np.einsum("bcd,bd->bc", self.vectors[ids], queries)
        for key, own, score in zip(keys, ids.tolist(), scores.tolist(), strict=True):
            met = sorted((-s, m, self.keys[i] == key) for i, s in zip(own, score, strict=True) if i >= 0 and s == s for m in self.members[i])
            yield from ((key, -s, m, same) for s, m, same in met[:k])


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(key, top) for each of ``queries`` (key, dim, vector): an array of the ``k`` best (score, vec_id, same), best first.

    ``same`` marks rows whose vector has the query's key.
    """
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, -(-queries.count() // query_rows))
    block = F.pmod(F.xxhash64("key", F.lit("block")), F.lit(blocks)).cast("int")
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"), F.lit(1).alias("kind"), F.lit(0).alias("node"), "key", "vector")
    given = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "node", "key", "vector", "members", "links", "entry")
    place = ["dim", "shard", "block"]
    rows = given.unionByName(asked, allowMissingColumns=True).repartition(*place).sortWithinPartitions(*place, "kind", "node")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept, shard = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (*place, "kind")])
            starts = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(0)])
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                group, kind, part = tuple(marks[:3, low].tolist()), marks[3, low], batch.slice(low, high - low)
                if group != current:
                    current, kept, shard = group, [], None
                if kind == 0:
                    kept.append(part)
                    continue
                if shard is None and kept:
                    shard, kept = _Shard(kept), []
                if shard is None:  # no nodes of this length here
                    continue
                for at in range(0, part.num_rows, BATCH):
                    some = part.slice(at, BATCH)
                    found = list(shard.search(some.column("key").to_pylist(), _matrix(some.column("vector"), some.num_rows), k, beam))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.binary(), pa.float64(), pa.int64(), pa.bool_()), strict=True)], ["key", "score", "vec_id", "same"])

    met = rows.mapInArrow(walk, "key binary, score double, vec_id long, same boolean")
    best = met.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k)
    top = F.sort_array(F.collect_list(F.struct("place", "score", "vec_id", "same")))
    return best.groupBy("key").agg(F.transform(top, lambda t: F.struct(t["score"], t["vec_id"], t["same"])).alias("top"))


def nearest(vectors: DataFrame, k: int, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row whose ``id`` meets the SQL condition ``is_query``.

    Nearest first, ties to the smaller id; a query's own row is no candidate, its copies are. Rows whose id or vector is
    null, or whose vector is zero, empty or not finite, take no part; a vector meets only those of its own length; inner
    products that are not a number are left out. Repeated ids are separate rows. An empty table gives no rows; texts and
    other columns, whatever their names, are ignored.
    """
    nodes = cut(classes(vectors, id_col, vector_col, k + 1), "nodes")
    asked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(_usable("vector")).where(is_query)
    asked = cut(asked.select("id", F.unhex(F.substring(F.sha2(F.col("vector").cast("string"), 256), 1, 32)).alias("key")), "asked")
    index = build_index(nodes, shard_rows)
    # Equal queries are searched once. Of a key that very many queries share, adaptive execution splits the last join.
    distinct = cut(nodes.join(asked.select("key").distinct(), "key", "left_semi").select("key", "dim", "vector"), "queries")
    found = cut(search(index, distinct, k + 1, beam, query_rows), "found")
    own = F.array_position(F.transform("top", lambda t: t["same"] & (t["vec_id"] == F.col("id"))), True)
    rows = asked.join(found, "key").withColumn("own", own)
    others = F.slice(F.filter("top", lambda t, i: i + 1 != F.col("own")), 1, k)
    rows = rows.select("id", F.posexplode(others).alias("at", "t"))
    return rows.select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20, "id % 20 = 0")


QUERIES = {"op11_neighbours": op11_neighbours}
ORACLE_SQL: dict[str, str] = {}
