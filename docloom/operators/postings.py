"""A search index of three-letter grams: which texts may hold a phrase is read from postings, and only those texts are looked at.

Texts are dealt to shards of bounded size by a hash of their id. A posting row holds the ids of one gram in one shard, so no
row grows with the corpus, however frequent a gram is. Postings lie in folders by a hash of the gram, sorted by it; texts
lie in folders by shard. A search reads the folders of its grams, and of the texts the shards that have candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.plans.book import Book, scratch, table

BOOK = Book()
#: Characters of a gram, texts of a shard on average, folders of grams.
GRAM, SHARD_TEXTS, FOLDERS = 3, 1_000, 64


#: Characters of a shard's texts whose grams are sorted at once.
AT_ONCE = 4_000_000


def _runs(columns: list[list[str | None]], ranks: list[int]) -> Iterator[tuple[list[int], list[str]]]:
    """Ranks and texts in runs of bounded size; a longer text is cut, its pieces share the characters of the grams at the cut."""
    held, size = ([], []), 0
    for column in columns:
        for rank, value in zip(ranks, column, strict=True):
            for at in range(0, len(value or "") - GRAM + 1 if rank >= 0 else 0, AT_ONCE):
                held[0].append(rank)
                held[1].append(value[at : at + AT_ONCE + GRAM - 1])
                size += len(held[1][-1])
                if size >= AT_ONCE:
                    yield held
                    held, size = ([], []), 0
    if held[0]:
        yield held


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def postings_of(texts: pa.Table) -> pa.Table:
    """(shard, gram, ids) of one shard; ``texts``: shard, id, then lower-cased columns. Rows with a null id are left out.

    A gram and the rank of its text's id are one number, so one sort gives the grams and the ids of each in order.
    """
    ids, columns = texts.column(1).combine_chunks(), [c.to_pylist() for c in texts.columns[2:]]
    order = pc.sort_indices(ids).to_numpy()[: len(ids) - ids.null_count]  # nulls come last
    rank, n = np.full(len(ids), -1), max(1, len(order))
    rank[order] = np.arange(len(order))
    letters = np.array(sorted(map(ord, set().union(*(v for c in columns for v in c if v)))), np.int64)
    k, place = max(1, len(letters)), np.zeros(letters.max(initial=0) + 1, np.int64)
    place[letters] = np.arange(len(letters))
    found = [np.zeros(0, np.int64)]
    for owners, run in _runs(columns, rank.tolist()):
        sizes = np.array([*map(len, run)])
        code = place[np.frombuffer("".join(run).encode("utf-32-le"), np.uint32)]
        key = ((code[:-2] * k + code[1:-1]) * k + code[2:]) * n + np.repeat(owners, sizes)[:-2]
        inside = np.ones(len(code), bool)  # a gram does not run over the end of its text
        inside[np.cumsum(sizes) - 1] = inside[np.cumsum(sizes) - 2] = False
        found.append(_distinct(key[inside[:-2]]))
    keys = _distinct(np.concatenate(found))
    grams = keys // n
    starts = np.flatnonzero(np.diff(grams, prepend=-1))
    names = grams[starts]
    spelled = letters[np.stack([names // (k * k), names // k % k, names % k], axis=1)].astype("<u4").tobytes().decode("utf-32-le") if len(names) else ""
    lists = pa.ListArray.from_arrays(pa.array([*starts, len(keys)], pa.int32()), ids.take(pa.array(order[keys % n], pa.int64())))
    shard = pa.array(np.full(len(names), texts.column(0)[0].as_py()), pa.int32())
    return pa.table({"shard": shard, "gram": pa.array([spelled[i : i + GRAM] for i in range(0, len(spelled), GRAM)], pa.string()), "ids": lists})


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


class Postings:
    """An index that was written to ``path``; ``build`` makes one, the constructor opens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.texts = spark.read.parquet(f"{path}/texts")
        ids = self.texts.schema.fields[0].dataType.simpleString()
        # The schema is stated, as an index without a gram has no files.
        self.postings = spark.read.schema(f"shard int, gram string, ids array<{ids}>, folder int").parquet(f"{path}/postings")

    @classmethod
    def build(cls, docs: DataFrame, path: str, columns: list[str], id_col: str = "doc_id") -> Postings:
        """Index ``columns`` of ``docs``, whose ids are unique; null values hold nothing.

        Texts are shuffled to their shards, and once more with their shard's other texts to be worked on as one; their grams
        are sorted there as numbers and leave it as one row for each gram of the shard. A shard has SHARD_TEXTS texts on average.
        """
        shards = max(1, -(-docs.count() // SHARD_TEXTS))
        shard = F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int")
        own = docs.select(id_col, *(c for c in docs.columns if c != id_col))
        own.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", id_col).write.partitionBy("shard").parquet(f"{path}/texts")
        texts = docs.sparkSession.read.parquet(f"{path}/texts")
        ids = dict(texts.dtypes)[id_col]
        low = texts.select("shard", F.col(id_col).alias("id"), *(F.lower(c).alias(f"c{n}") for n, c in enumerate(columns)))
        rows = low.groupBy("shard").applyInArrow(postings_of, f"shard int, gram string, ids array<{ids}>")
        rows.withColumn("folder", _folder(F.col("gram"))).repartition("folder").sortWithinPartitions("folder", "gram", "shard").write.partitionBy("folder").parquet(f"{path}/postings")
        return cls(docs.sparkSession, path)

    def candidates(self, phrase: str) -> DataFrame | None:
        """(shard, id) of the texts that have all grams of a phrase; None for a phrase too short to have any."""
        low = phrase.lower()
        own = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        if not own:
            return None
        folders = [r[0] for r in self.postings.sparkSession.createDataFrame([(g,) for g in own], "gram string").select(_folder(F.col("gram"))).distinct().collect()]
        rows = self.postings.where(F.col("folder").isin(folders) & F.col("gram").isin(own))
        both = rows.groupBy("shard").agg(F.count("*").alias("n"), F.collect_list("ids").alias("lists")).where(F.col("n") == len(own))
        return both.select("shard", F.explode(F.aggregate("lists", F.get("lists", F.lit(0)), F.array_intersect)).alias("id"))

    def holding(self, phrases: list[str], id_col: str = "doc_id") -> DataFrame:
        """Rows of the texts that may hold any of the phrases, each once: all that do, and few others. The caller verifies."""
        found = [self.candidates(p) for p in phrases]
        if any(f is None for f in found):
            return self.texts
        return self.texts.join(reduce(DataFrame.union, found).distinct().withColumnRenamed("id", id_col), ["shard", id_col], "left_semi")

    def keyword(self, query: str, limit: int, columns: list[str]) -> DataFrame:
        """(doc_id, matched_field): texts with the query in a column, newest first; the first column that has it is named."""
        has = lambda c: F.contains(F.lower(c), F.lit(query.lower()))
        field = reduce(lambda w, c: w.when(has(c), c), columns[1:], F.when(has(columns[0]), columns[0]))
        hits = self.holding([query]).select("doc_id", field.alias("matched_field")).where("matched_field is not null")
        return hits.orderBy(F.desc("doc_id")).limit(limit)

    def ranked(self, query: str, k: int, column: str = "text") -> DataFrame:
        """(doc_id, score): of the newest 5k texts with any term of the query, the k most relevant."""
        spark = self.texts.sparkSession
        terms = spark.range(1).select(text.query_terms(F.lit(query))).first()[0]
        scored = self.holding(terms).select("doc_id", text.relevance(F.col(column), F.array(*map(F.lit, terms))).alias("score")).where("score > 0")
        return scored.orderBy(F.desc("doc_id")).limit(5 * k).orderBy(F.desc("score"), F.desc("doc_id")).limit(k)


# --- queries ---
def _index(spark, sf_dir) -> Postings:
    return Postings.build(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), scratch(spark, "postings"), ["source", "text"])


@BOOK.add("""SELECT doc_id, matched_field FROM (SELECT doc_id, CASE WHEN contains(lower(source), 'apache lic') THEN 'source' WHEN contains(lower(text), 'apache lic') THEN 'text' END AS matched_field FROM documents)
WHERE matched_field IS NOT NULL ORDER BY doc_id DESC LIMIT 50""")
def ret1_keyword_postings(spark, sf_dir):
    """Keyword search by postings; of the texts only shards with candidates are read."""
    return _index(spark, sf_dir).keyword("Apache Lic", 50, ["source", "text"])


@BOOK.add("""WITH s AS (SELECT doc_id, (CASE WHEN contains(lower(text), 'license') THEN 3.0::DOUBLE ELSE 0 END) + (CASE WHEN contains(lower(text), 'token') THEN 2.5::DOUBLE ELSE 0 END) AS score FROM documents),
n AS (SELECT * FROM s WHERE score > 0 ORDER BY doc_id DESC LIMIT 50) SELECT doc_id, score FROM n ORDER BY score DESC, doc_id DESC LIMIT 10""")
def ret5_ranking_postings(spark, sf_dir):
    """Ranking of chunks by the terms of a query, by postings."""
    return _index(spark, sf_dir).ranked("license token", 10)
