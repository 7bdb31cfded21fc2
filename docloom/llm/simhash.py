"""Operator 7, SimHash near-duplicates: binary trie self-join over 64-bit fingerprints.

Fingerprints that differ in at most ``budget`` bits are linked, and linked documents form a component. The join walks
pairs of nodes of a binary trie from the top: both nodes of a pair lead down to their children, each step that takes
different bits spends one of the budget, and a pair that has spent more is dropped with everything below it.

The walk is spread as follows. Of ``budget + 1`` equal parts of a fingerprint, a pair within the budget has at least
one part without a differing bit. So the trie is walked once for each part, with that part's bits on top, and on those
levels only equal nodes can be paired: that stretch of the walk is a shuffle key. The levels below are walked inside a
task over the sorted fingerprints of the key, where a node is a range of rows. Keys with many fingerprints are taken
apart in the same way over their remaining bits, so no group holds a fixed share of all rows. Equal fingerprints are
one row from the start, and a task reports links that join its fingerprints into trees, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import components, cut, text_batches

BITS, BUDGET, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of one key up to which it is walked as it is; larger keys are taken apart further.
GROUP_ROWS = 4_096
#: Node pairs that are held at once during a walk; further ones wait on a stack.
FRONTIER = 200_000


def fingerprint(text: str | None) -> int:
    """SimHash of the XXH64 of all word shingles; fewer words than a shingle are one shingle, no words give zero."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: lowers A-Z, splits at \x20 and \x09-\x0D
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for part in np.array_split(hashes, len(hashes) // 65_536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long, one row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(text.as_py()) for text in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    text_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fp long")


#: SQL: masks of BUDGET + 1 parts of equal size of the bits that are set in ``varying``; fewer where few are set.
_PARTS = f"""transform(array(filter(sequence(0, {BITS - 1}), b -> getbit(varying, b) = 1)), bs -> transform(array(cast((size(bs) + {BUDGET}) div {BUDGET + 1} as int)), s ->
    transform(sequence(0, cast((size(bs) - 1) div s as int)), j -> aggregate(slice(bs, j * s + 1, s), 0L, (m, b) -> m | shiftleft(1L, b))))[0])[0]"""


def deal(prints: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, fp): each distinct fingerprint under every key at which the walk below is to go on.

    A key names the parts chosen so far and their bits. A pair within the budget shares at least one key: what is taken
    apart is whole keys, again over BUDGET + 1 parts, now of the bits that vary among the key's own fingerprints. Each
    round thus halves a large key at least, and it goes on until no key is larger than ``group_rows`` (or has no more
    varying bits than the budget, which are 8 fingerprints at most).
    """
    dealt = cut(prints.select("fp").distinct(), "distinct").select(F.lit("").alias("key"), F.lit(-1).cast("long").alias("varying"), "fp")
    dealt = dealt.select("key", F.explode(F.expr(_PARTS)).alias("mask"), "fp")
    done: list[DataFrame] = []
    while True:
        dealt = cut(dealt.select(F.concat_ws("|", "key", F.hex("mask"), F.hex(F.col("fp").bitwiseAND(F.col("mask")))).alias("key"), "fp"), "trie")
        large = dealt.groupBy("key").agg(F.count("*").alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying"))
        large = cut(large.where((F.col("n") > group_rows) & (F.bit_count("varying") > BUDGET)).select("key", F.expr(_PARTS).alias("masks")), "large")
        if large.isEmpty():
            return _union([*done, dealt])
        done.append(dealt.join(large, "key", "left_anti"))
        dealt = dealt.join(large, "key").select("key", F.explode("masks").alias("mask"), "fp")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def trie_links(prints: np.ndarray, groups: np.ndarray | None = None, budget: int = BUDGET, frontier: int = FRONTIER) -> list[tuple[int, int]]:
    """Links (as places in ``prints``) that join all prints of a group within the budget into trees.

    ``groups`` has the places where groups start (one group if None); prints are distinct and sorted within each. A node
    is a range [a, b) of rows that agree on all bits above a level. A frontier holds node pairs with the bits they differ
    in so far, at first each group with itself; one step takes all of them one level down. Wide frontiers are halved, and
    one half waits.
    """
    n = len(prints)
    if n < 2:
        return []
    bits = ((prints[:, None] >> np.arange(BITS - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(bool)
    ones = np.zeros((n + 1, BITS), dtype=np.int32)
    np.cumsum(bits, axis=0, out=ones[1:])
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links: list[tuple[int, int]] = []
    starts = np.zeros(1, dtype=np.int64) if groups is None else np.asarray(groups)
    ends = np.append(starts[1:], n)
    whole = ends - starts > 1
    starts, ends = starts[whole].astype(np.int32), ends[whole].astype(np.int32)
    wait = [(0, np.stack([starts, ends, starts, ends], 1), np.zeros(len(starts), dtype=np.int32))]
    while wait:
        level, pairs, spent = wait.pop()
        while level < BITS and len(pairs):
            if len(pairs) > frontier:
                half = len(pairs) // 2
                wait.append((level, pairs[half:], spent[half:]))
                pairs, spent = pairs[:half], spent[:half]
            a, b, c, d = pairs.T
            # In a sorted range, rows with a 0 at this level come first.
            m, k = b - (ones[b, level] - ones[a, level]), d - (ones[d, level] - ones[c, level])
            own = a == c  # a node with itself: its children pair once, not in both orders
            steps = [
                (np.stack([a, m, c, k], 1), spent, None), (np.stack([m, b, k, d], 1), spent, None),
                (np.stack([a, m, k, d], 1), spent + 1, None), (np.stack([m, b, c, k], 1), spent + 1, ~own),
            ]
            kept, cost = [], []
            for nodes, used, also in steps:
                ok = (nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3]) & (used <= budget)
                ok &= ~((nodes[:, 0] == nodes[:, 2]) & (nodes[:, 1] - nodes[:, 0] == 1))  # one row with itself
                if also is not None:
                    ok &= also
                kept.append(nodes[ok])
                cost.append(used[ok])
            pairs, spent, level = np.concatenate(kept), np.concatenate(cost), level + 1
        for i, j in zip(pairs[:, 0].tolist(), pairs[:, 2].tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((i, j))
    return links


def links(prints: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose components are those of all links.

    The keys of a partition come sorted, and all that a batch holds whole are walked together.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if held is None or held.empty:
                continue
            key = held["key"].to_numpy()
            starts = np.flatnonzero(key[1:] != key[:-1]) + 1
            at = len(held) if batch is None else int(starts[-1]) if len(starts) else 0  # the last key may go on in the next batch
            ready, held = held["fp"].to_numpy(np.int64)[:at].view(np.uint64), held.iloc[at:]
            if not len(ready):
                continue
            starts = np.concatenate([[0], starts[starts < at]])
            own = ready[np.lexsort((ready, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, at)))))]
            found = np.array(trie_links(own, starts), dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": own[found[:, 0]].view(np.int64), "b": own[found[:, 1]].view(np.int64)})

    n = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = deal(prints, group_rows).repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInPandas(walk, "a long, b long")


def _classes(docs: DataFrame, id_col: str, text_col: str, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """(id, fp) for each row of ``docs`` and (fp, component_id) for each distinct fingerprint."""
    prints = cut(fingerprints(docs, id_col, text_col), "prints")
    edges = components(links(prints, group_rows)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    least = cut(least.join(edges, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes")
    return prints, least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``; component_id is the smallest id reachable by links.

    Null and empty texts have fingerprint zero and link like any other. Rows with null ids are linked too, but never
    name a component unless it has no other id. Repeated rows get equal results, an empty table gives no rows, other
    columns are ignored. A very long text is one fingerprint over all of its shingles.
    """
    prints, named = _classes(docs, id_col, text_col, group_rows)
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, nulls last, of repeated ids that with the least digest.

    An id that is null or repeated can lie in several components, so components are named by id and digest together:
    these stand for one text, which lies in one component.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))
    names = rows.select(F.struct(F.col("id").isNull().alias("absent"), "id", "digest").alias("name"), F.col("row").getField(text_col).alias("text"))
    chosen = _classes(names, "name", "text")[1].select(F.col("component_id.id").alias("kept"), F.col("component_id.digest").alias("least")).distinct()
    rows = rows.join(chosen, rows["id"].eqNullSafe(chosen["kept"]) & (rows["digest"] == chosen["least"]), "left_semi")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("id", "digest").orderBy("digest"))).where("n = 1").select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_simhash": op7_simhash}
ORACLE_SQL: dict[str, str] = {}
