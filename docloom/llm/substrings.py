"""Operator 8, substring dedup: FM-indexes per shard, searched backward over wavelet trees.

A window is ``width`` consecutive words. Every word is removed that stands in a window whose words also start earlier,
in a document with a smaller id or earlier in the same document.

Sharding. Each window has an anchor, the least hash among its grams of ANCHOR words, so equal windows have equal anchors.
Consecutive windows with one anchor make a segment, about a seventh of the windows long. Anchors that occur once are done
with after a count; only segments of repeated anchors move, and a shard holds whole anchors, so that all occurrences of a
window meet in one shard.

Equal segments are one: all but the first go whole. Where an anchor has several different segments, their words go to
the anchor's shard, which builds a compressed FM-index of them (the BWT as a wavelet tree of packed bits and every
SAMPLE-th place of the suffix order) and streams them through it. From every end position the search goes backward one
word at a time while the match still occurs twice, so it finds the matching statistic up to ``width`` words; where that is
reached, the window is reported with the least position in its interval, found by walking back to sampled places. An
anchor whose segments are more than a shard holds is cut into segments by anchors of longer grams, which go to shards of
their own; the longest gram is a whole window, whose segments are all equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, forget, text_batches

WIDTH, ANCHOR = 20, 6
#: Words of a document that are hashed at once, windows that are searched at once.
BLOCK_WORDS, BLOCK_WINDOWS = 50_000, 200_000
#: Words that a shard's index holds on average; an anchor with more is cut by the next of these grams (the last is a window).
SHARD_WORDS, GRAMS = 200_000, (ANCHOR, 13, WIDTH)
#: Every so many places of the suffix order are kept.
SAMPLE = 8

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(size: int) -> list[np.ndarray]:
    if len(_powers[0]) < size:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(2 * size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def gram_hashes(words: list[bytes], gram: int) -> np.ndarray:
    """A 64-bit hash of every run of ``gram`` words, from prefix sums of a polynomial over their bytes."""
    if len(words) < gram:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    starts = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
    ends = np.concatenate([starts[1:] - 1, [len(data)]])
    h = (total[ends[gram - 1 :]] - total[starts[: len(words) - gram + 1]]) * inverse[starts[: len(words) - gram + 1]]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h


def anchors(words: list[bytes], width: int = WIDTH, gram: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of every segment of a list of words."""
    out = []
    for base in range(0, max(len(words) - width + 1, 0), BLOCK_WORDS):
        own = words[base : base + BLOCK_WORDS + width - 1]
        h = gram_hashes(own, gram)
        grams, span, size = h, width - gram + 1, 1
        while 2 * size <= span:
            h, size = np.minimum(h[:-size], h[size:]), 2 * size
        if size < span:
            h = np.minimum(h[: len(h) - (span - size)], h[span - size :])
        # The anchor is another one if the value changes, or if it stood at the start of the window before.
        cuts = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (h[:-1] == grams[: len(h) - 1])) + 1])
        out.append((h[cuts].view(np.int64), cuts + base, np.diff(np.concatenate([cuts, [len(h)]]))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


class WaveletTree:
    """Rank over an integer sequence: one level of packed bits for each bit of the symbols, most significant first."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.size, self.levels = len(symbols), []
        for bit in range(max(int(largest).bit_length(), 1) - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            packed = np.zeros((self.size // 64 + 1) * 8, dtype=np.uint8)
            raw = np.packbits(ones, bitorder="little")
            packed[: len(raw)] = raw
            blocks = packed.view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)[:-1]])
            self.levels.append((bit, blocks, before, self.size - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

        every = np.arange(int(largest) + 1)
        self.origin = self._down(every, np.zeros(len(every), dtype=np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each place leads to at the lowest level if its symbol's bits are followed."""
        for bit, blocks, before, zeros in self.levels:
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(blocks[word] & mask)
            at = np.where(symbols >> bit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the sequence."""
        return self._down(symbols, at) - self.origin[symbols]

    def look(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before."""
        symbols = np.zeros(len(at), dtype=np.int64)
        for bit, blocks, before, zeros in self.levels:
            word, low = at >> 6, (at & 63).astype(np.uint64)
            here = blocks[word]
            ones = before[word] + np.bitwise_count(here & ((np.uint64(1) << low) - np.uint64(1)))
            one = (here >> low & np.uint64(1)).astype(bool)
            symbols |= one.astype(np.int64) << bit
            at = np.where(one, zeros + ones, at - ones)
        return symbols, at - self.origin[symbols]


class FMIndex:
    """Index of an integer text that ends with its only 0. Of the suffix order only every ``sample``-th place of the text is kept."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        n, rank = len(text), text.astype(np.int64)
        size, kinds = 1, 0
        while kinds < n:  # the last symbol is unique, so all suffixes differ in the end
            after = np.zeros(n, dtype=np.int64)
            after[: n - size] = rank[size:] + 1
            found, rank = np.unique(rank * (n + 2 + int(text.max(initial=0))) + after, return_inverse=True)
            size, kinds = 2 * size, len(found)
        places = np.empty(n, dtype=np.int64)
        places[rank] = np.arange(n)
        largest = int(text.max(initial=0))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        self.tree = WaveletTree(text[places - 1].astype(np.int64), largest)
        self.marked = places % sample == 0
        self.sampled = places[self.marked].astype(np.int32)
        self.before = np.cumsum(self.marked, dtype=np.int32) - self.marked

    def back(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns that have one more symbol in front."""
        base = self.below[symbols]
        return base + self.tree.rank(symbols, low), base + self.tree.rank(symbols, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the suffix order: steps back to the place before, until one is sampled."""
        out, live, at, steps = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), rows, 0
        while len(live):
            hit = self.marked[at]
            out[live[hit]] = self.sampled[self.before[at[hit]]] + steps
            live, at = live[~hit], at[~hit]
            symbols, n = self.tree.look(at)
            at, steps = self.below[symbols] + n, steps + 1
        return out


def repeated_windows(parts: list[str], width: int = WIDTH) -> list[list[dict]]:
    """For each part, in order of first occurrence, the runs of words in its windows that also start earlier."""
    words = [part.split(" ") for part in parts]
    names = {name: i + 2 for i, name in enumerate(dict.fromkeys(w for part in words for w in part))}
    text = np.array([1, *(s for part in words for s in [*map(names.__getitem__, part), 1]), 0], dtype=np.int64)
    starts = np.cumsum([1, *(len(part) + 1 for part in words)])[:-1]
    index = FMIndex(text)
    ends = np.concatenate([np.arange(s + width - 1, s + len(part)) for s, part in zip(starts, words, strict=True)])
    first = ends - width + 1
    seen = np.zeros(len(ends), dtype=bool)
    for at in range(0, len(ends), BLOCK_WINDOWS):
        live = np.arange(at, min(at + BLOCK_WINDOWS, len(ends)))
        low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), len(text), dtype=np.int64)
        for step in range(width):
            low, high = index.back(text[ends[live] - step], low, high)
            more = high - low > 1
            live, low, high = live[more], low[more], high[more]
        if len(live):
            where, order, group = np.unique(low, return_index=True, return_inverse=True)
            sizes = high[order] - where
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            rows = np.repeat(where - begins, sizes) + np.arange(sizes.sum())
            least = np.minimum.reduceat(index.locate(rows), begins)
            seen[live] = least[group] < first[live]
    out = []
    bounds = np.cumsum([0, *(len(part) - width + 1 for part in words)])
    for a, b in zip(bounds, bounds[1:], strict=False):
        hit = np.flatnonzero(seen[a:b])
        cuts = np.flatnonzero(np.diff(hit) > width) + 1
        out.append([{"off": int(run[0]), "length": int(run[-1] - run[0]) + width} for run in np.split(hit, cuts) if len(run)])
    return out


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # of bytes: splits at \x20 and \x09-\x0D


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, digest, start, length): runs of words that are to be removed; ``docs`` has id (long), digest and text."""
    spark = docs.sparkSession
    text_batches(spark)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(_words(text.as_py()), width) for text in batch.column(2)]
            rows = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            anchor, start, n = (np.concatenate([f[k] for f in found] or [np.zeros(0)]).astype(t) for k, t in enumerate(("i8", "i4", "i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(anchor), pa.array(start), pa.array(n)], ["id", "digest", "anchor", "start", "n"])

    every = cut(docs.select("id", "digest", "text").mapInArrow(segments, "id long, digest long, anchor long, start int, n int"), "segments")
    # Written first, so that the join's sides are plain exchanges and adaptive execution can split an anchor with very many rows.
    twice = cut(every.groupBy("anchor").count().where("count > 1").select("anchor"), "twice")
    some = cut(every.join(twice, "anchor").select("id", "digest", "anchor", "start", "n"), "repeated")
    forget(every)
    wanted = some.groupBy("id", "digest").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("parts"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, digest, text, parts in zip(*(batch.column(k) for k in range(4)), strict=True):
                words = _words(text.as_py())
                for part in parts.as_py():
                    own = b" ".join(words[part["start"] : part["start"] + part["n"] + width - 1])
                    out.append((key.as_py(), digest.as_py(), part["anchor"], part["start"], part["n"], xxhash.xxh3_128_digest(own), own.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)], ["id", "digest", "anchor", "start", "n", "same", "part"])

    texts = docs.select("id", "digest", "text")
    spelled = texts.join(wanted, ["id", "digest"]).select("id", "digest", "text", "parts").mapInArrow(spell, "id long, digest long, anchor long, start int, n int, same binary, part string")
    spelled = cut(spelled, "spelled")
    forget(some)
    forget(twice)
    owned = spelled.select(F.col("id").alias("owner"), F.col("digest").alias("text"), "id", "start", "anchor", "same", "n", "part")
    out = _settled(owned, width, 0).select(F.col("owner").alias("id"), F.col("text").alias("digest"), "start", "length")
    out = cut(out, "repeats")
    forget(spelled)
    return out


def _settled(owned: DataFrame, width: int, level: int) -> DataFrame:
    """(owner, text, start, length): runs to be removed of segments (owner, text, id, start, anchor, same, n, part).

    ``owner`` and ``text`` name what a segment belongs to, ``id`` and ``start`` where it stands.
    """
    spark = owned.sparkSession
    held = cut(owned.groupBy("anchor", "same").agg(F.min(F.struct("id", "start")).alias("first"), F.max("n").alias("n"), F.first("part").alias("part")), "held")
    occurrences = cut(owned.drop("part"), "occurrences")
    kinds = cut(held.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + width).alias("size")).where("kinds > 1"), "kinds")
    last = level == len(GRAMS) - 1
    small = F.lit(True) if last else F.col("size") <= SHARD_WORDS
    size, large = kinds.agg(F.sum(F.when(small, F.col("size"))), F.count_if(~small)).first()
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // SHARD_WORDS))
    mixed = held.join(kinds, "anchor")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "start"], kind="stable")
        return pd.DataFrame({"anchor": rows["anchor"], "same": rows["same"], "gone": repeated_windows(rows["part"].tolist(), width)})

    cold = mixed.where(small).select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "anchor", "same", "first.id", "first.start", "part")
    gone = cold.groupBy("shard").applyInPandas(search, "anchor long, same binary, gone array<struct<off:int,length:int>>").where(F.size("gone") > 0)
    if large:
        gram = min(GRAMS[level + 1], width)

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for owner, text, key, start, part in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    words = part.encode().split(b" ")
                    for anchor, off, n in zip(*(c.tolist() for c in anchors(words, width, gram)), strict=True):
                        own = b" ".join(words[off : off + n + width - 1])
                        out.append((owner, text, key, start + off, anchor, xxhash.xxh3_128_digest(own), n, own.decode()))
                kinds_ = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, kinds_, strict=True)], ["owner", "text", "id", "start", "anchor", "same", "n", "part"])

        hot = mixed.where(~small).select(F.col("anchor").alias("owner"), F.col("same").alias("text"), "first.id", "first.start", "part")
        hot = cut(hot.mapInArrow(again, "owner long, text binary, id long, start int, anchor long, same binary, n int, part string"), "hot")
        runs = _settled(hot, width, level + 1).withColumnsRenamed({"owner": "anchor", "text": "same"}).join(held.select("anchor", "same", "first"), ["anchor", "same"])
        runs = runs.groupBy("anchor", "same").agg(F.collect_set(F.struct((F.col("start") - F.col("first.start")).alias("off"), "length")).alias("gone"))
        gone = gone.unionByName(runs)
    gone = cut(gone, "gone")
    # Joined by place as well: segments that very many documents share are dealt by document and not by the segment.
    first = held.select("anchor", "same", "first.id", "first.start", F.lit(True).alias("is_first")).join(gone, ["anchor", "same"], "left")
    rows = occurrences.join(first, ["anchor", "same", "id", "start"], "left")
    whole = rows.where(F.col("is_first").isNull()).select("owner", "text", "start", (F.col("n") + width - 1).alias("length"))
    parts = rows.where(F.col("gone").isNotNull()).select("owner", "text", "start", F.explode("gone").alias("g"))
    return whole.unionByName(parts.select("owner", "text", (F.col("start") + F.col("g.off")).alias("start"), F.col("g.length").alias("length")))


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): the words of each whole text that stay, joined by single spaces.

    Null and empty texts have no words; texts of fewer words than a window lose none. Rows alike in id and text get
    equal results and do not count as earlier for each other; null ids come before all others. An empty table gives no
    rows, other columns are ignored. A very long text is one list of words in the task that reads it.
    """
    least = F.lit(-(2**63)).cast("long")  # stands for null
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), least).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
    runs = repeats(rows, width).groupBy("id", "digest").agg(F.collect_set(F.struct("start", "length")).alias("runs"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                words = _words(text.as_py())
                keep = np.ones(len(words), dtype=bool)
                for run in runs.as_py() or ():
                    keep[run["start"] : run["start"] + run["length"]] = False
                kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            n, gone, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    joined = rows.join(runs, ["id", "digest"], "left").select("id", "text", "runs")
    return joined.mapInArrow(strip, "id long, n_words long, n_removed long, kept string").select(F.nullif("id", least).alias(id_col), "n_words", "n_removed", "kept")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op8_substrings": op8_substrings}
ORACLE_SQL = {
    "op8_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i+19], ' ')))) AS h FROM d WHERE len(w) >= 20),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
per AS (SELECT doc_id, count(g.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY word.p) FILTER (g.p IS NULL), '') AS kept FROM word LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)"""
}
