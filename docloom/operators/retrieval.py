"""Scalar functions over the corpus and retrieval: keyword, vector and hybrid search, ranking, claims and triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import numbers, text
from docloom.plans.book import Book, table

BOOK = Book()
#: Verbs of triples, most sentences of a chunk that become claims, words that signal a result.
VERBS = "created|supports|uses|contains|requires|extends|includes|produces"
MAX_CLAIMS = 4
RESULT_SIGNAL = r"(?i)\b(achieved|achieves|outperform|outperformed|improve|improved|increase|increased|decrease|decreased|significant|accuracy|f1|auc|precision|recall|limitation|limited|conclude|conclusion|result|results)\b|[%=><±]"


def keyword_search(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """Documents with the query in a column, newest first; the first column that has it is named."""
    has = lambda c: F.contains(F.lower(c), F.lit(query.lower()))
    field = F.when(has("source"), "source").when(has("text"), "text")
    hits = docs.select("doc_id", field.alias("matched_field"), text.snippet(F.col("text"), query).alias("snippet")).where("matched_field is not null")
    return hits.withColumn("score", F.lit(1.0)).orderBy(F.desc("doc_id")).limit(limit)


def vector_search(vectors: DataFrame, query: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """The k nearest vectors by cosine, above ``least``; ``query`` is one row with ``q``. A top-k, never a full sort."""
    scored = vectors.crossJoin(F.broadcast(query)).select("vec_id", numbers.cosine(F.col("embedding"), F.col("q")).alias("score"))
    return scored.where(F.col("score") > least).orderBy(F.desc("score"), "vec_id").limit(k)


def hybrid_search(docs: DataFrame, chunks: DataFrame, query: str, query_vector: DataFrame, k: int) -> DataFrame:
    """Keyword hits score 1; each vector hit among the best 2k adds 0.7 of its similarity to its document."""
    words = docs.where(F.contains(F.lower("text"), F.lit(query.lower()))).select("doc_id", F.lit(1.0).alias("base"))
    near = vector_search(chunks, query_vector, 2 * k).join(chunks.select("vec_id", "doc_id"), "vec_id").groupBy("doc_id").agg((F.sum("score") * 0.7).alias("added"))
    both = words.join(near, "doc_id", "full").select("doc_id", (F.coalesce("base", F.lit(0.0)) + F.coalesce("added", F.lit(0.0))).alias("score"))
    return both.orderBy(F.desc(F.round("score", 6)), "doc_id").limit(k)


def rank_chunks(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """Of the newest 5k chunks with any term of the query, the k most relevant."""
    terms = text.query_terms(F.lit(query))
    scored = chunks.select("doc_id", text.relevance(F.col("text"), terms).alias("score")).where("score > 0")
    newest = scored.orderBy(F.desc("doc_id")).limit(5 * k)
    return newest.orderBy(F.desc("score"), F.desc("doc_id")).limit(k)


def claims(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Up to four claim sentences of each chunk, with their type."""
    parts = F.filter(text.claim_sentences(F.col(text_col)), lambda s: F.length(s).between(24, 500) & s.rlike(RESULT_SIGNAL))
    rows = chunks.select(id_col, F.posexplode(F.slice(parts, 1, MAX_CLAIMS)).alias("pos", "claim"))
    return rows.select(id_col, F.col("pos").cast("long").alias("pos"), "claim", text.claim_type(F.col("claim")).alias("claim_type"))


def triples(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Subject, predicate and object of each sentence that is nothing but a triple."""
    pattern = rf"^\s*([A-Z][A-Za-z0-9_-]{{1,80}})\s+({VERBS})\s+([A-Za-z0-9_-]{{1,80}})\s*$"
    rows = chunks.select(id_col, F.posexplode(F.split(text_col, r"[.;]\s*", -1)).alias("seq", "s")).where(F.col("s").rlike(pattern))
    part = lambda i: F.regexp_extract("s", pattern, i)
    return rows.select(id_col, "seq", part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object"))


def entities(found: DataFrame, id_col: str) -> DataFrame:
    """One entity a document and lower-case name, spelled as its first mention by order of the text."""
    mention = F.explode(F.array(*(F.struct(F.col("seq"), F.lit(i).alias("side"), F.col(c).alias("name")) for i, c in enumerate(("subject", "object")))))
    both = found.select(id_col, mention.alias("m"))
    return both.groupBy(id_col, F.lower("m.name").alias("normalized")).agg(F.min_by("m.name", F.struct("m.seq", "m.side")).alias("name"))


def bag_embedding(words: Column, dim: int) -> Column:
    """Sparse hash embedding of a bag of tokens: slot to count over the Euclidean norm, as a map by slot."""
    slots = F.transform(words, lambda w: numbers.hash_slot(w, dim))
    counts = F.transform(F.array_sort(F.array_distinct(slots)), lambda s: F.struct(s.alias("slot"), F.size(F.filter(slots, lambda t: t == s)).cast("double").alias("n")))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, c: a + c["n"] * c["n"]))
    return F.transform(counts, lambda c: F.struct(c["slot"].alias("slot"), (c["n"] / norm).alias("weight")))


@BOOK.add(r"""SELECT doc_id, CAST(greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9_./:-]+')) + 0 + (length(regexp_replace(text, '[\sA-Za-z0-9_./:\-]', '', 'g')) + 3) // 4) AS BIGINT) AS tokens FROM documents""")
def str1_estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@BOOK.add("""SELECT item_id, array_to_string(list_slice(t, 1, 15), ' ') AS terms FROM (SELECT item_id, list_transform(list_sort(list_transform(list_distinct(x), lambda v: list_position(x, v))), lambda p: x[p]) AS t FROM (SELECT item_id, regexp_extract_all(lower(text), '[A-Za-z0-9_]+') AS x FROM benchmark))""")
def str2_query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


@BOOK.add("""SELECT doc_id, (CASE WHEN contains(lower(text), 'license') THEN 3.0::DOUBLE ELSE 0 END) + (CASE WHEN contains(lower(text), 'the') THEN 1.5::DOUBLE ELSE 0 END) + (CASE WHEN contains(lower(text), 'a') THEN 1.0::DOUBLE ELSE 0 END) AS score FROM documents""")
def str3_relevance(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.relevance(F.col("text"), text.query_terms(F.lit("License the A the"))).alias("score"))


@BOOK.add("""WITH p AS (SELECT doc_id, text, instr(lower(text), 'license') AS hit FROM documents), q AS (SELECT *, greatest(1, hit - 80) AS s, least(length(text), hit - 1 + 7 + 80) AS e FROM p)
SELECT doc_id, CASE WHEN hit > 0 THEN (CASE WHEN s > 1 THEN '...' ELSE '' END) || trim(substr(text, s, e - s + 1), E' \\n\\t\\r') || (CASE WHEN e < length(text) THEN '...' ELSE '' END) ELSE trim(substr(text, 1, 160), E' \\n\\t\\r') END AS snippet FROM q""".replace("\\\\", "\\"))
def str4_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), "License").alias("snippet"))


@BOOK.add(r"SELECT doc_id, sha256(regexp_replace(trim(text, E' \n\t\r'), '(?m)[ \t\r\f]+$', '', 'g')) AS content_hash FROM documents")
def str5_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@BOOK.add(r"SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 500) AS summary FROM documents")
def str6_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.summary(F.col("text")).alias("summary"))


@BOOK.add(r"""SELECT doc_id, 'document_' || doc_id || '_' || substr(sha256(text), 1, 12) AS collection FROM documents""")
def str7_collection_name(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", F.lit("document"), F.col("doc_id").cast("string"), F.substring(F.sha2("text", 256), 1, 12)).alias("collection"))


@BOOK.add(r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: trim(regexp_replace(regexp_replace(p, '\s*\n\s*', ' ', 'g'), '[ \t]+', ' ', 'g'), E' \n\t\r')), lambda p: p <> ''), E'\n\n') AS cleaned FROM documents""")
def str9_paragraphs_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.paragraphs(F.col("text")).alias("cleaned"))


@BOOK.add(r"""SELECT doc_id, CAST(len(list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?]+[。！？.!?]?'), lambda s: trim(s, E' \n\t\r')), lambda s: s <> '')) AS BIGINT) AS sentences FROM documents""")
def str13_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("sentences"))


@BOOK.add("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'economy') THEN 'limitation' ELSE 'result' END AS t FROM (SELECT p_partkey, replace(p_type, 'ECONOMY', 'LIMITED ECONOMY') AS p_type FROM part)""")
def str15_claim_type(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.claim_type(F.replace("p_type", F.lit("ECONOMY"), F.lit("LIMITED ECONOMY"))).alias("t"))


@BOOK.add("SELECT p_partkey, CAST(nullif(regexp_extract(p_brand, '([-+]?(?:[0-9]+\\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE) AS number FROM part".replace("\\\\", "\\"))
def str18_first_number(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.first_number(F.col("p_brand")).alias("number"))


@BOOK.add("""SELECT doc_id, generate_series AS i, substr(text, generate_series * 1080 + 1, 1200) AS piece FROM (SELECT doc_id, text, unnest(generate_series(0, (greatest(length(text) - 120, 1) - 1) // 1080)) AS generate_series FROM documents) WHERE trim(substr(text, generate_series * 1080 + 1, 1200), E' \\n\\t\\r') <> ''""".replace("\\\\", "\\"))
def str26_fixed_width(spark, sf_dir):
    starts = F.sequence(F.lit(1), F.greatest(F.length("text") - 120, F.lit(1)), F.lit(1080))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("text"), i, F.lit(1200)))).alias("i", "piece"))
    return rows.where(text.strip(F.col("piece")) != "").withColumn("i", F.col("i").cast("long"))


@BOOK.add("SELECT doc_id, sha256(text) AS h, substr(sha1(concat_ws('|', source, lang)), 1, 16) AS signature FROM documents")
def hsh1_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.substring(F.sha1(F.concat_ws("|", "source", "lang")), 1, 16).alias("signature"))


@BOOK.add("""SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings""")
def math1_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return vectors.crossJoin(F.broadcast(query)).select("vec_id", F.round(numbers.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


@BOOK.add("""SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(corr(l_quantity, l_extendedprice) * corr(l_quantity, l_extendedprice), 6) AS r2 FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 3 AND count(DISTINCT l_quantity) >= 2""")
def math2_axis_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.regr_slope("l_extendedprice", "l_quantity").alias("s"), F.regr_intercept("l_extendedprice", "l_quantity").alias("i"), F.corr("l_quantity", "l_extendedprice").alias("r"), F.count("*").alias("n"), F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b")
    )
    return rows.where("n >= 3 and a < b").select("l_suppkey", F.round("s", 4).alias("slope"), F.round("i", 2).alias("intercept"), F.round(F.pow("r", F.lit(2)), 6).alias("r2"))


@BOOK.add("""SELECT l_suppkey, CASE WHEN count(*) FILTER (l_extendedprice > 0) >= 2 AND max(l_extendedprice) FILTER (l_extendedprice > 0) / min(l_extendedprice) FILTER (l_extendedprice > 0) >= 100 THEN 'log10' ELSE 'linear' END AS scale FROM lineitem GROUP BY l_suppkey""")
def math3_scale(spark, sf_dir):
    positive = F.when(F.col("l_extendedprice") > 0, F.col("l_extendedprice"))
    log = numbers.log_scale(F.min(positive), F.max(positive), F.count(positive))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.when(log, "log10").otherwise("linear").alias("scale"))


@BOOK.add("""SELECT doc_id, matched_field FROM (SELECT doc_id, CASE WHEN contains(lower(source), 'license') THEN 'source' WHEN contains(lower(text), 'license') THEN 'text' END AS matched_field FROM documents) WHERE matched_field IS NOT NULL ORDER BY doc_id DESC LIMIT 50""")
def ret1_keyword(spark, sf_dir):
    return keyword_search(table(spark, sf_dir, "documents"), "License", 50).select("doc_id", "matched_field")


@BOOK.add("""WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 3) SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q), 6) AS score FROM embeddings, q WHERE list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q) > 0 ORDER BY list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q) DESC, vec_id LIMIT 10""")
def ret2_vector(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search(vectors, vectors.where("vec_id = 3").select(F.col("embedding").alias("q")), 10).select("vec_id", F.round("score", 6).alias("score"))


@BOOK.add("""WITH c AS (SELECT vec_id, vec_id // 2 AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT e AS q FROM c WHERE vec_id = 3),
v AS (SELECT doc_id, list_cosine_similarity(e, q) AS s FROM c, q WHERE list_cosine_similarity(e, q) > 0 ORDER BY s DESC, vec_id LIMIT 40), n AS (SELECT doc_id, sum(s) * 0.7::DOUBLE AS added FROM v GROUP BY doc_id),
w AS (SELECT doc_id, 1.0::DOUBLE AS base FROM documents WHERE contains(lower(text), 'license'))
SELECT doc_id, round(coalesce(base, 0) + coalesce(added, 0), 6) AS score FROM w FULL JOIN n USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20""")
def ret3_hybrid(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings").withColumn("doc_id", F.expr("vec_id div 2"))
    query = chunks.where("vec_id = 3").select(F.col("embedding").alias("q"))
    return hybrid_search(table(spark, sf_dir, "documents"), chunks, "License", query, 20).select("doc_id", F.round("score", 6).alias("score"))


@BOOK.add("""WITH s AS (SELECT doc_id, (CASE WHEN contains(lower(text), 'license') THEN 3.0::DOUBLE ELSE 0 END) + (CASE WHEN contains(lower(text), 'token') THEN 2.5::DOUBLE ELSE 0 END) AS score FROM documents),
n AS (SELECT * FROM s WHERE score > 0 ORDER BY doc_id DESC LIMIT 50) SELECT doc_id, score FROM n ORDER BY score DESC, doc_id DESC LIMIT 10""")
def ret5_chunk_ranking(spark, sf_dir):
    return rank_chunks(table(spark, sf_dir, "documents"), "license token", 10)


@BOOK.add(r"""WITH s AS (SELECT doc_id, trim(regexp_replace(x, '\s+', ' ', 'g')) AS claim, i FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?。！？])\s+', '\1␞', 'g'), '␞|\n+') AS l FROM documents))),
f AS (SELECT doc_id, claim, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM s WHERE length(claim) BETWEEN 24 AND 500 AND regexp_matches(claim, '(?i)\b(achieved|achieves|outperform|outperformed|improve|improved|increase|increased|decrease|decreased|significant|accuracy|f1|auc|precision|recall|limitation|limited|conclude|conclusion|result|results)\b|[%=><±]'))
SELECT doc_id, pos, claim, CASE WHEN regexp_matches(lower(claim), 'limitation|limited|fail|cannot') THEN 'limitation' WHEN regexp_matches(lower(claim), 'outperform|better than|compared|versus|vs\.') THEN 'comparison' WHEN regexp_matches(lower(claim), 'method|approach|framework|model') THEN 'method' WHEN regexp_matches(lower(claim), 'conclude|conclusion|therefore') THEN 'conclusion' ELSE 'result' END AS claim_type FROM f WHERE pos < 4""")
def doc10_claims(spark, sf_dir):
    return claims(table(spark, sf_dir, "documents"), "doc_id", "text")


@BOOK.add("""SELECT c_custkey, c_name AS subject, 'uses' AS predicate, 'Segment' || substr(c_mktsegment, 1, 3) AS object FROM (SELECT c_custkey, replace(c_name, '#', '_') AS c_name, c_mktsegment FROM customer)""")
def doc11_triples(spark, sf_dir):
    said = F.concat(F.lit("Intro words here. "), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit(" uses Segment"), F.substring("c_mktsegment", 1, 3), F.lit("; no triple in this one"))
    return triples(table(spark, sf_dir, "customer").select("c_custkey", said.alias("t")), "c_custkey", "t").drop("seq")


@BOOK.add("""WITH t AS (SELECT item_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS w FROM benchmark), c AS (SELECT item_id, CAST(('0x' || substr(sha256(w), 1, 2))::BIGINT % 768 AS INTEGER) AS slot, count(*)::DOUBLE AS n FROM t GROUP BY ALL)
SELECT item_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS weight FROM c""".replace("\\\\", "\\"))
def doc8_hash_embedding(spark, sf_dir):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return table(spark, sf_dir, "benchmark").select("item_id", F.inline(bag_embedding(words, 768))).withColumn("weight", F.round("weight", 6))


@BOOK.add("""WITH t AS (SELECT unnest(['license','token','version']) AS w), s AS (SELECT doc_id, count(*) AS hits FROM documents, t WHERE contains(lower(text), w) GROUP BY doc_id)
SELECT doc_id, hits, coalesce(quality, 0) AS high FROM s LEFT JOIN labels USING (doc_id) ORDER BY hits DESC, high DESC, doc_id DESC LIMIT 8""")
def ret8_claim_answer(spark, sf_dir):
    terms = F.array(*(F.lit(t) for t in ("license", "token", "version")))
    scored = table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(terms, lambda t: F.contains(F.lower(F.col("text")), t))).cast("long").alias("hits")).where("hits > 0")
    rows = scored.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "hits", F.coalesce("quality", F.lit(0)).alias("high"))
    return rows.orderBy(F.desc("hits"), F.desc("high"), F.desc("doc_id")).limit(8)
