"""Operator 10, benchmark decontamination: prefix-filtered set join with exact verification. DataFrame functions only.

A benchmark item gives the windows of ``width`` consecutive words of it (all its words if it has fewer). A window can
only occur in a document that holds all of its words, so in the prefix-filter scheme with words ordered by rarity the
necessary prefix is one word: the window's rarest over all documents. Document words that are such prefix words become
candidates with the few words around them; the join on the word checks the positional bound (the window starts in the
document), the length bound (it ends in it) and then equality of all words. Any further work is done on true matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

WIDTH = 10
#: UTF-8 bytes of distinct words up to which texts are searched for them as they are split; beyond, positions are joined by word.
WORD_BYTES = 2_000_000
#: UTF-8 bytes of windows or counts up to which they are sent to every task; beyond, they are joined by shuffle.
SMALL_BYTES = 4_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """(item, win): each distinct window of each item as an array of words. Items without words have none."""
    own = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return own.where(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("win")).distinct()


def _bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.octet_length(column) + 16)).first()[0] or 0


def _in(names: list[str]) -> str:
    """SQL list of words; the pattern of words leaves no quote or backslash in them."""
    return ", ".join(f"'{name}'" for name in names) or "''"


def rarity(docs: DataFrame, vocabulary: DataFrame, text_col: str) -> DataFrame:
    """(word, n): how often each word of the vocabulary stands in all documents; words that never do are left out."""
    if _bytes(vocabulary, "word") <= WORD_BYTES:
        names = sorted(row[0] for row in vocabulary.collect())
        found = docs.select(words(F.col(text_col)).alias("w")).select(F.explode(F.expr(f"filter(w, x -> x in ({_in(names)}))")).alias("word"))
        return found.groupBy("word").agg(F.count("*").alias("n"))
    counts = docs.select(F.explode(words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.join(vocabulary, "word", "left_semi")


def prefixes(docs: DataFrame, wins: DataFrame, text_col: str) -> DataFrame:
    """(token, offset, win) for each distinct window: its rarest word and where the window has it first.

    Windows with a word that no document has are left out: they occur nowhere.
    """
    each = wins.select("win").distinct()
    placed = each.select("win", F.posexplode("win").alias("offset", "word"))
    vocabulary = cut(placed.select("word").distinct(), "vocabulary")
    counts = cut(rarity(docs, vocabulary, text_col), "rarity")
    if _bytes(counts, "word") <= SMALL_BYTES:  # else a common word is split by adaptive execution
        counts = F.broadcast(counts)
    known = placed.join(counts, "word", "left").groupBy("win").agg(
        F.min(F.struct("n", "word", "offset")).alias("first"), F.count("n").alias("known")
    )
    return known.where(F.col("known") == F.size("win")).select(F.col("first.word").alias("token"), F.col("first.offset").alias("offset"), "win")


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(rows, hits): rows has (id, digest, n_words) of every row of ``docs``, hits every occurrence of every window.

    hits: (id, digest, start, length, item), start in words from 0. Rows that are alike in id and text have one set of
    hits between them, found by (id, digest); null ids are allowed, null and empty texts have no words.
    """
    wins = cut(windows(benchmark, width, item_col, text_col), "windows")
    tokens = cut(prefixes(docs, wins, text_col), "prefixes")
    near = f"named_struct('pos', i, 'token', ws[i], 'near', slice(ws, greatest(i - {width - 1}, 0) + 1, i + {width} - greatest(i - {width - 1}, 0)))"
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.array(words(F.col(text_col))).alias("held"))
    names = cut(tokens.select("token").distinct(), "tokens")
    if _bytes(names, "token") <= WORD_BYTES:
        known = _in([row[0] for row in names.orderBy("token").collect()])
        at = f"filter(transform(ws, (w, i) -> if(w in ({known}), {near}, null)), x -> x is not null)"
    else:  # positions first; only those of prefix words go back to their text for the words around them
        each = slim.select("id", "digest", F.posexplode(F.col("held")[0]).alias("pos", "token")).join(names, "token", "left_semi")
        places = each.groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).agg(F.array_sort(F.collect_set("pos")).alias("places"))
        slim = slim.join(places, slim["id"].eqNullSafe(places["_id"]) & (slim["digest"] == places["_digest"]), "left")
        at = f"transform(coalesce(places, array()), i -> {near})"
    slim = slim.select("id", "digest", F.expr(f"transform(held, ws -> named_struct('n', size(ws), 'at', {at}))[0]").alias("s"))
    slim = cut(slim, "candidates")
    found = slim.select("id", "digest", F.col("s.n").alias("n"), F.explode("s.at").alias("c")).select("id", "digest", "n", "c.*")
    start = F.col("pos") - F.col("offset")
    same = F.slice("near", F.greatest(F.least("pos", F.lit(width - 1)) - F.col("offset") + 1, F.lit(1)), F.size("win")) == F.col("win")
    # The bounds and the comparison are part of the join, so that only true matches leave it.
    rule = (found["token"] == tokens["token"]) & (start >= 0) & (start + F.size("win") <= F.col("n")) & same
    small = _bytes(tokens.select(F.array_join("win", " ").alias("w")), "w") <= SMALL_BYTES
    hits = found.join(F.broadcast(tokens) if small else tokens, rule).select("id", "digest", start.alias("start"), "win").distinct()
    hits = cut(hits, "hits")
    return slim.select("id", "digest", F.col("s.n").alias("n_words")), hits.join(wins, "win").select("id", "digest", "start", F.size("win").alias("length"), "item")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, digest, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    n_hit: words inside any occurrence of a window; items: those with an occurring window. An empty benchmark hits
    nothing, an empty table gives no rows, equal rows get equal results, other columns are ignored. Null and empty texts
    have no words; a very long text is one array of words in the task that splits it.
    """
    rows, hits = matches(docs, benchmark, width, id_col, text_col, item_col)
    ends = "aggregate(array_sort(spans), named_struct('to', 0, 'n', 0), (a, x) -> named_struct('to', greatest(a.to, x.start + x.length), 'n', a.n + greatest(x.start + x.length - greatest(a.to, x.start), 0)), a -> a.n)"
    per = hits.groupBy("id", "digest").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("item").alias("items"))
    per = per.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.expr(ends).cast("long").alias("n_hit"), F.array_sort("items").alias("items"))
    joined = rows.join(per, rows["id"].eqNullSafe(per["_id"]) & (rows["digest"] == per["_digest"]), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("id").alias(id_col), "digest", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which a window of the benchmark occurs."""
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col).where("contaminated").select(F.col(id_col).alias("bad"), F.col("digest").alias("bad_digest"))
    bad = cut(bad.distinct(), "contaminated")
    if bad.count() <= SMALL_BYTES // 40:
        bad = F.broadcast(bad)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))
    return rows.join(bad, rows["id"].eqNullSafe(bad["bad"]) & (rows["digest"] == bad["bad_digest"]), "left_anti").select("row.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("digest")


QUERIES = {"op10_decontamination": op10_decontamination}
_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT item, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i+9], ' '))) AS win, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS win FROM d, lens WHERE len(w) >= n),
hit AS (SELECT DISTINCT doc_id, s, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
}
