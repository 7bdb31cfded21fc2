"""Evidence for the plans of a run: where in its document each plan's values are looked for.

All plans of all documents are searched at once. A plan meets the chunks of its own document only, so the join is an equi
join on the document; while plans are few they go to all tasks and texts and vectors stay where they lie. Of each plan the
best chunks are kept in every partition before they are shuffled. What a hit names
is looked up among the sections, tables and figures the document is known to have, and the lists of a plan are filled by
ordered fallbacks, as tiers of one table of candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import numbers, text
from docloom.operators.fragments import keywords
from docloom.plans.book import Book, sent, table, written

BOOK = Book()
#: Kinds of chunks by what they stand for, where a chunk's metadata name it and its section, most hits and characters of a query.
TABLE_CHUNKS, FIGURE_CHUNKS = ["table", "table_asset"], ["figure", "image", "visual", "diagram"]
CAPTION_CHUNKS, BODY_CHUNKS = ["caption", "figcaption"], ["body", "text", "paragraph"]
LABEL_KEYS = ["label", "table_label", "figure_label", "caption_label", "title", "id"]
SECTION_KEYS = ["section", "section_heading", "section_title", "title"]
OTHER_SECTION_KEYS = ["section_title", "section_heading", "section_name", "heading", "heading_text", "source"]
HITS, QUERY_CHARS = 10, 500
#: Tiers of candidates: hints, keywords, the first figures, the document's pictures, hits by meaning, defaults.
HINT, KEYWORD, POSITION, PICTURE, MEANING, DEFAULT = range(1, 7)


def norm(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", ""))


def first_of(metadata: str, keys: list[str]) -> Column:
    """The first key of a JSON object whose value is not blank, stripped; else the empty string."""
    return F.coalesce(*(F.nullif(text.strip(F.get_json_object(metadata, f"$.{k}")), F.lit("")) for k in keys), F.lit(""))


def query_text(wanted: DataFrame) -> Column:
    """What a plan is searched by: its field, entity and keywords."""
    return F.substring(F.array_join(F.filter(F.concat(F.array("field", "entity"), "keywords"), lambda w: F.coalesce(w, F.lit("")) != ""), " "), 1, QUERY_CHARS)


def has_keyword(body: Column, words: Column) -> Column:
    """Whether a text has any keyword of any of the phrases ``words``, in any case."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return F.exists(F.flatten(F.transform(F.coalesce(words, F.array().cast("array<string>")), keywords)), lambda k: F.contains(low, k))


def nearest_chunks(wanted: DataFrame, chunks: DataFrame, k: int = HITS, least: float = 0.0) -> DataFrame:
    """(doc, field, place, chunk): for every plan the ``k`` chunks of its document nearest by cosine, above 0 and not below ``least``.

    A plan without any such chunk gets the first ones whose text has its query as it stands. ``wanted``: doc, field, entity,
    keywords, q; ``chunks``: doc, chunk, text, embedding. Ties go to the chunk that comes first.
    """
    plans = wanted.select("doc", "field", "q", query_text(wanted).alias("query"))
    score = numbers.cosine(F.col("embedding"), F.col("q"))
    met = chunks.select("doc", "chunk", "embedding").join(sent(plans.drop("query")), "doc").select("doc", "field", "chunk", score.alias("score")).where((F.col("score") > 0) & (F.col("score") >= least))
    best = Window.partitionBy("doc", "field").orderBy(F.desc("score"), "chunk")
    near = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("doc", "field", "place", "chunk")
    near = written(near, "near")  # a few rows of each plan, read for the hits and for the plans without any
    rest = plans.select("doc", "field", "query").join(near.select("doc", "field").distinct(), ["doc", "field"], "left_anti").where(text.strip(F.col("query")) != "")
    if rest.isEmpty():
        return near
    said = chunks.select("doc", "chunk", "text").join(sent(rest), "doc").where(F.contains(F.lower("text"), F.lower(text.strip(F.col("query")))))
    first = Window.partitionBy("doc", "field").orderBy("chunk")
    words = said.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).select("doc", "field", "place", "chunk")
    return near.unionByName(words)


def meant(wanted: DataFrame, chunks: DataFrame, sources: DataFrame, k: int = HITS) -> DataFrame:
    """(doc, field, kind, place, label): the sections, tables, figures and captions that the nearest chunks of each plan name.

    A label counts if the document has such a source, but for case and white space; a caption's label counts as it is. A
    chunk names its section in its metadata; one of plain text with any of the query's keywords may name it elsewhere there.
    ``chunks`` also have chunk_type and metadata (JSON); ``sources``: doc, kind, seq, label, body.
    """
    known = sources.where("label is not null").groupBy("doc", "kind", norm(F.col("label")).alias("key")).agg(F.max_by("label", "seq").alias("known"))
    queries = wanted.select("doc", "field", query_text(wanted).alias("query"))
    kind, meta = F.lower(F.coalesce("chunk_type", F.lit(""))), "metadata"
    near = nearest_chunks(wanted, chunks, k).join(queries, ["doc", "field"])
    hits = chunks.drop("embedding").join(sent(near), ["doc", "chunk"])
    label, section = first_of(meta, LABEL_KEYS), first_of(meta, SECTION_KEYS)
    # Of the sections named elsewhere the first that is known counts: each is tried in order.
    tries = F.array(*(F.struct(F.lit(i).alias("try"), F.coalesce(F.get_json_object(meta, f"$.{key}"), F.lit("")).alias("name")) for i, key in enumerate(OTHER_SECTION_KEYS, 1)))
    plain = kind.isin(BODY_CHUNKS) & has_keyword(F.col("text"), F.array("query"))
    named = F.concat(
        F.array(F.struct(F.lit("section").alias("kind"), F.lit(0).alias("try"), section.alias("name"))), F.when(plain, F.transform(tries, lambda t: F.struct(F.lit("section").alias("kind"), t["try"].alias("try"), t["name"].alias("name")))).otherwise(F.array()),
        F.when(kind.isin(TABLE_CHUNKS), F.array(F.struct(F.lit("table").alias("kind"), F.lit(0).alias("try"), label.alias("name")))).otherwise(F.array()),
        F.when(kind.isin(FIGURE_CHUNKS), F.array(F.struct(F.lit("figure").alias("kind"), F.lit(0).alias("try"), label.alias("name")))).otherwise(F.array()),
    )
    looked = hits.select("doc", "field", "place", F.explode(named).alias("n")).select("doc", "field", "place", "n.*").where("name <> ''").withColumn("key", norm(F.col("name")))
    found = looked.join(known, ["doc", "kind", "key"]).groupBy("doc", "field", "kind", "place").agg(F.min_by("known", "try").alias("label"))
    captions = hits.where(kind.isin(CAPTION_CHUNKS) & (label != "")).select("doc", "field", F.lit("caption").alias("kind"), "place", label.alias("label"))
    return found.select("doc", "field", "kind", "place", "label").unionByName(captions)


def evidence_for(wanted: DataFrame, chunks: DataFrame, sources: DataFrame, pictures: DataFrame, strict: bool = False, k: int = HITS) -> DataFrame:
    """(doc, field, kind, place, label): the sources of each plan, in the order they are read.

    By kind: what the plan's mapping names; without that sources with a keyword; for a plan that needs a figure then the
    first two figures of the document, or its pictures. Hits by meaning are added. Without any section the first two are
    read, without any table the first that has a label, and a plan with nothing at all gets the first section. ``strict``
    leaves only hints, first figures and that section. Labels that differ by case alone are one.

    ``wanted``: doc, field, entity, keywords, q, needs_figure and the arrays sections, tables and figures; ``sources``: doc,
    kind (section, table, figure), seq, label, body (what keywords are looked for in); ``pictures``: doc, seq, label.
    """
    row = lambda df, kind, tier, seq, label: df.select("doc", "field", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(tier).alias("tier"), seq.cast("long").alias("seq"), label.alias("label"))
    # Terms and lower-case texts are made before plans meet sources, once for each.
    words = F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(F.array("field"))
    plans = wanted.select("doc", "field", F.coalesce("needs_figure", F.lit(False)).alias("needs_figure"), F.array_distinct(F.flatten(F.transform(words, keywords))).alias("terms"))
    own = sources.where("label is not null")
    tiers = [row(wanted.select("doc", "field", F.posexplode(c).alias("seq", "label")), kind, HINT, F.col("seq"), F.col("label")) for kind, c in (("section", "sections"), ("table", "tables"), ("figure", "figures"))]
    rank = lambda kind: F.row_number().over(Window.partitionBy("doc").orderBy("seq"))
    first = sources.where("kind = 'figure'").withColumn("n", rank("figure")).where("n <= 2 and label is not null")
    needy = plans.where("needs_figure").select("doc", "field")
    tiers.append(row(needy.join(first, "doc"), "figure", POSITION, F.col("seq"), F.col("label")))
    sections = sources.where("kind = 'section'").withColumn("n", rank("section"))
    if not strict:
        said = own.select("doc", "kind", "seq", "label", F.lower(F.concat_ws(" ", F.when(F.col("kind") == "section", F.col("label")), "body")).alias("said"))
        hits = said.join(sent(plans.drop("needs_figure")), "doc").where(F.exists("terms", lambda t: F.contains(F.col("said"), t)))
        tiers.append(row(hits, F.col("kind"), KEYWORD, F.col("seq"), F.col("label")))
        tiers.append(row(needy.join(pictures, "doc"), "figure", PICTURE, F.col("seq"), F.col("label")))
        tiers.append(row(meant(wanted, chunks, sources, k), F.col("kind"), MEANING, F.col("place"), F.col("label")))
        tiers.append(row(plans.join(sections.where("n <= 2"), "doc"), "section", DEFAULT, F.col("seq"), F.col("label")))
        labelled = own.where("kind = 'table'").groupBy("doc").agg(F.min_by(F.struct("seq", "label"), "seq").alias("t"))
        tiers.append(row(plans.join(labelled, "doc"), "table", DEFAULT, F.col("t.seq"), F.col("t.label")))
    rows = reduce(DataFrame.unionByName, tiers).withColumn("label", text.strip(F.col("label"))).where("label <> ''")
    # A document's sources share labels: of each the first is kept where it is found.
    rows = rows.groupBy("doc", "field", "kind", "tier", "label").agg(F.min("seq").alias("seq"))
    # Of hints, keywords, first figures and pictures the first tier that has any; hits are added; defaults only where nothing is.
    by = Window.partitionBy("doc", "field", "kind")
    least = F.min(F.when(F.col("tier") <= PICTURE, F.col("tier"))).over(by)
    rows = rows.withColumns({"least": least, "any": F.min("tier").over(by)})
    rows = rows.where((F.col("tier") == F.col("least")) | (F.col("tier") == MEANING) | ((F.col("tier") == DEFAULT) & (F.col("any") == DEFAULT)))
    once = rows.groupBy("doc", "field", "kind", F.lower("label").alias("same")).agg(F.min(F.struct("tier", "seq", "label")).alias("f"))
    bare = plans.select("doc", "field").join(once.select("doc", "field").distinct(), ["doc", "field"], "left_anti")
    last = row(bare.join(sections.where("n = 1"), "doc"), "section", DEFAULT, F.col("seq"), F.col("label"))
    rows = once.select("doc", "field", "kind", "f.*").unionByName(last)
    place = F.row_number().over(by.orderBy("tier", "seq", "label"))
    return rows.select("doc", "field", "kind", place.cast("long").alias("place"), "label")


# --- queries: plans of benchmark items, chunks with the vectors of embeddings and the texts of documents, sources from documents ---
PLAN_COLUMNS = [
    "item_id % 25 AS doc", "concat('field ', item_id) AS field", "CASE WHEN item_id % 4 = 1 THEN '' ELSE concat('entity ', item_id % 7) END AS entity", "item_id % 3 = 0 AS needs_figure",
    "CASE WHEN item_id % 6 = 0 THEN 'nowhere' ELSE substr(text, 40 + item_id % 50, 12) END AS phrase", "item_id % 5 = 2 AS hinted", "item_id AS vector",
]
CHUNK_COLUMNS = [
    "vec_id AS chunk", "vec_id % 25 AS doc", "text", "embedding",
    "CASE vec_id % 8 WHEN 0 THEN 'Table' WHEN 1 THEN 'figure' WHEN 2 THEN 'caption' WHEN 3 THEN 'table_asset' WHEN 4 THEN 'diagram' ELSE 'text' END AS chunk_type",
    """CASE vec_id % 5 WHEN 0 THEN concat('{"label": "TABLE  ', vec_id % 40, '", "section": "part ', vec_id % 30, '"}')
    WHEN 1 THEN concat('{"label": " ", "figure_label": "figure ', vec_id % 40, '", "section_name": "Unknown", "heading": "Part ', vec_id % 60, '"}')
    WHEN 2 THEN concat('{"title": "Part ', vec_id % 30, '"}') WHEN 3 THEN concat('{"caption_label": "Table', vec_id % 40, '", "source": "PART ', vec_id % 60, '"}') ELSE '{}' END AS metadata""",
]
SOURCE_COLUMNS = [
    "doc_id % 25 AS doc", "doc_id AS seq", "text AS body", "CASE doc_id % 3 WHEN 0 THEN 'section' WHEN 1 THEN 'table' ELSE 'figure' END AS kind",
    "CASE WHEN doc_id % 11 = 5 THEN NULL WHEN doc_id % 3 = 0 THEN concat('Part ', doc_id % 30) WHEN doc_id % 3 = 1 THEN concat('Table ', doc_id % 40) ELSE concat('Figure ', doc_id % 40) END AS label",
]
INPUT_SQL = f"""pl AS (SELECT p.*, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS q, trim(concat_ws(' ', p.field, nullif(p.entity, ''), p.phrase))[1:500] AS query FROM (SELECT {', '.join(PLAN_COLUMNS)} FROM benchmark) p JOIN embeddings e ON e.vec_id = p.vector),
pw AS (SELECT *, list_filter(string_split(trim(regexp_replace(lower(phrase), '[^\\p{{L}}\\p{{N}}_%·°^\\\\-]+', ' ', 'g')), ' '), lambda w: w <> '' AND length(w) <= 40) AS words,
  list_filter(string_split(trim(regexp_replace(lower(query), '[^\\p{{L}}\\p{{N}}_%·°^\\\\-]+', ' ', 'g')), ' '), lambda w: w <> '' AND length(w) <= 40) AS query_words FROM pl),
ch AS (SELECT {', '.join(CHUNK_COLUMNS)} FROM embeddings JOIN documents ON doc_id = vec_id), so AS (SELECT {', '.join(SOURCE_COLUMNS)} FROM documents),
met AS (SELECT field, chunk, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), q) AS score FROM pw JOIN ch USING (doc)),
near AS (SELECT field, chunk, row_number() OVER (PARTITION BY field ORDER BY score DESC, chunk) AS place FROM met WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY field ORDER BY score DESC, chunk) <= 10),
said AS (SELECT field, chunk, row_number() OVER (PARTITION BY field ORDER BY chunk) AS place FROM pw JOIN ch USING (doc) WHERE field NOT IN (SELECT field FROM near) AND contains(lower(text), lower(query)) QUALIFY row_number() OVER (PARTITION BY field ORDER BY chunk) <= 10),
hit AS (SELECT * FROM near UNION ALL SELECT * FROM said)"""
MEANT_SQL = r""", known AS (SELECT doc, kind, replace(lower(label), ' ', '') AS key, arg_max(label, seq) AS known FROM so WHERE label IS NOT NULL GROUP BY ALL),
h AS (SELECT p.doc, p.field, place, lower(chunk_type) AS ct, text, query_words, metadata AS m FROM hit JOIN pw p USING (field) JOIN ch USING (chunk)),
j AS (SELECT *, coalesce(nullif(trim(m ->> '$.label'), ''), m ->> '$.table_label', m ->> '$.figure_label', m ->> '$.caption_label', m ->> '$.title', '') AS label,
  coalesce(m ->> '$.section', m ->> '$.section_heading', m ->> '$.section_title', m ->> '$.title', '') AS section, ct = 'text' AND len(list_filter(query_words, lambda w: contains(lower(text), w))) > 0 AS plain FROM h),
looked AS (SELECT doc, field, place, 'section' AS kind, 0 AS try, section AS name FROM j UNION ALL SELECT doc, field, place, 'section', 3, coalesce(m ->> '$.section_name', '') FROM j WHERE plain UNION ALL SELECT doc, field, place, 'section', 4, coalesce(m ->> '$.heading', '') FROM j WHERE plain
  UNION ALL SELECT doc, field, place, 'section', 6, coalesce(m ->> '$.source', '') FROM j WHERE plain UNION ALL SELECT doc, field, place, 'table', 0, label FROM j WHERE ct IN ('table', 'table_asset') UNION ALL SELECT doc, field, place, 'figure', 0, label FROM j WHERE ct IN ('figure', 'diagram')),
meant AS (SELECT l.doc, field, l.kind, place, arg_min(known, try) AS label FROM looked l JOIN known k ON k.doc = l.doc AND k.kind = l.kind AND k.key = replace(lower(name), ' ', '') WHERE name <> '' GROUP BY l.doc, field, l.kind, place
  UNION ALL SELECT doc, field, 'caption', place, label FROM j WHERE ct = 'caption' AND label <> '')"""
EVIDENCE_SQL = r""", rs AS (SELECT *, row_number() OVER (PARTITION BY doc, kind ORDER BY seq) AS n FROM so), pic AS (SELECT p_partkey % 25 AS doc, p_partkey AS seq, concat('Asset ', p_partkey % 90) AS label FROM part WHERE p_size < 25 AND p_partkey % 25 > 20),
c AS (SELECT doc, field, 'section' AS kind, 1 AS tier, 0 AS seq, 'Part 1' AS label FROM pw WHERE hinted UNION ALL SELECT doc, field, 'section', 1, 1, ' part 1 ' FROM pw WHERE hinted UNION ALL SELECT doc, field, 'figure', 1, 0, 'Figure 77' FROM pw WHERE hinted AND vector % 2 = 0
  UNION ALL SELECT doc, field, 'figure', 3, rs.seq, label FROM pw JOIN rs USING (doc) WHERE needs_figure AND kind = 'figure' AND n <= 2 AND label IS NOT NULL
  UNION ALL SELECT doc, field, kind, 2, so.seq, label FROM pw JOIN so USING (doc) WHERE label IS NOT NULL AND len(list_filter(words, lambda w: contains(lower(CASE WHEN kind = 'section' THEN label || ' ' || body ELSE body END), w))) > 0
  UNION ALL SELECT doc, field, 'figure', 4, pic.seq, label FROM pw JOIN pic USING (doc) WHERE needs_figure UNION ALL SELECT doc, field, kind, 5, place, label FROM meant
  UNION ALL SELECT doc, field, kind, 6, rs.seq, label FROM pw JOIN rs USING (doc) WHERE kind = 'section' AND n <= 2 UNION ALL SELECT doc, field, 'table', 6, t.seq, t.label FROM pw JOIN (SELECT doc, min(seq) AS seq, arg_min(label, seq) AS label FROM so WHERE kind = 'table' AND label IS NOT NULL GROUP BY doc) t USING (doc)),
d AS (SELECT doc, field, kind, tier, seq, trim(label) AS label, min(CASE WHEN tier <= 4 THEN tier END) OVER w AS least_, min(tier) OVER w AS any_ FROM c WHERE trim(coalesce(label, '')) <> '' WINDOW w AS (PARTITION BY doc, field, kind)),
e AS (SELECT doc, field, kind, min({'tier': tier, 'seq': seq, 'label': label}) AS f FROM d WHERE tier = least_ OR tier = 5 OR (tier = 6 AND any_ = 6) GROUP BY doc, field, kind, lower(label)),
g AS (SELECT doc, field, kind, f.tier AS tier, f.seq AS seq, f.label AS label FROM e UNION ALL SELECT doc, field, 'section', 6, rs.seq, label FROM pw JOIN rs USING (doc) WHERE kind = 'section' AND n = 1 AND field NOT IN (SELECT field FROM e))
SELECT doc, field, kind, row_number() OVER (PARTITION BY doc, field, kind ORDER BY tier, seq, label) AS place, label FROM g"""


def _inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    vectors, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    plans = table(spark, sf_dir, "benchmark").selectExpr(*PLAN_COLUMNS).join(vectors.select(F.col("vec_id").alias("vector"), F.col("embedding").alias("q")), "vector")
    hint = lambda when, *names: F.when(when, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    plans = plans.withColumns({"keywords": F.array("phrase"), "sections": hint(F.col("hinted"), "Part 1", " part 1 "), "tables": hint(F.lit(False), "x"), "figures": hint(F.col("hinted") & (F.col("vector") % 2 == 0), "Figure 77")})
    chunks = vectors.join(docs.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").selectExpr(*CHUNK_COLUMNS)
    pictures = table(spark, sf_dir, "part").where("p_size < 25 and p_partkey % 25 > 20").selectExpr("p_partkey % 25 AS doc", "p_partkey AS seq", "concat('Asset ', p_partkey % 90) AS label")
    return plans, chunks, docs.selectExpr(*SOURCE_COLUMNS), pictures


@BOOK.add(f"WITH {INPUT_SQL} SELECT field, place, chunk FROM hit")
def ext3_nearest_chunks(spark, sf_dir):
    """The ten chunks of its document nearest to each plan: all plans and all chunks in one join."""
    plans, chunks, *_ = _inputs(spark, sf_dir)
    return nearest_chunks(plans, chunks).select("field", F.col("place").cast("long").alias("place"), "chunk")


@BOOK.add(f"WITH {INPUT_SQL}{MEANT_SQL} SELECT field, kind, place, label FROM meant")
def ext3_semantic_hits(spark, sf_dir):
    """What the nearest chunks name: sections, tables, figures and captions of the document."""
    plans, chunks, sources, _ = _inputs(spark, sf_dir)
    return meant(plans, chunks, sources).select("field", "kind", F.col("place").cast("long").alias("place"), "label")


@BOOK.add(f"WITH {INPUT_SQL}{MEANT_SQL}{EVIDENCE_SQL}")
def ext3_evidence(spark, sf_dir):
    """The sources of each plan by hints, keywords, positions, pictures, meaning and defaults."""
    return evidence_for(*_inputs(spark, sf_dir))
