"""A document library's own work: search with fallbacks, sources of answers, assets to show, notes, deletions, queues and rules for files."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import numbers, text
from docloom.operators import documents, evidence
from docloom.operators.fragments import markdown_cells, note_pieces
from docloom.operators.retrieval import vector_search
from docloom.plans import derived
from docloom.plans.book import Book, sent, table
from docloom.plans.derived import ASSETS, ITEMS, TABLES, cte

BOOK = Book()
#: Source types that each processing mode takes, and the strategy it chooses.
TYPES = {"pdf": ["pdf"], "text": ["txt", "text"], "image": ["image"], "markdown": ["markdown", "md"], "preview": ["epub", "docx", "video"]}
MODES = [
    ("auto", "pdf", "pdf_text_with_ocr_fallback"), ("auto", "image", "image_ocr"), ("auto", "markdown", "markdown_structure"), ("auto", "md", "markdown_structure"), ("auto", "epub", "epub_reader_preview"), ("auto", "docx", "download_preview_only"),
    ("auto", "video", "video_preview"), ("auto", "txt", "plain_text"), ("auto", "text", "plain_text"), ("plain_text", "txt", "plain_text"), ("plain_text", "text", "plain_text"), ("pdf_text", "pdf", "pdf_text_with_ocr_fallback"), ("scanned_pdf_ocr", "pdf", "ocr_first_pdf"),
    ("image_ocr", "image", "image_ocr"), ("markdown_notes", "markdown", "markdown_structure"), ("markdown_notes", "md", "markdown_structure"), ("table_image_ocr", "image", "table_image_ocr"),
    *(("basic_file_parser", t, "basic_file_parser") for t in ("pdf", "txt", "text", "markdown", "md")),
]
#: Kinds of figures by words of a caption; the first that holds.
FIGURE_TYPES = [
    ("architecture_diagram", ["architecture", "framework", "model overview"]), ("flowchart", ["flowchart", "workflow", "pipeline"]), ("bar_chart", ["bar chart", "barplot", "histogram"]), ("line_chart", ["line chart", "trend", "curve"]),
    ("scatter_plot", ["scatter", "umap", "tsne", "t-sne"]), ("microscope_image", ["microscope", "microscopy", "sem", "tem"]), ("colony_image", ["colony"]), ("material_image", ["material", "sample", "film"]),
]
#: Rough chart types by words of a caption.
CHART_WORDS = [
    ("bar", ["bar", "histogram", "柱状"]), ("scatter", ["scatter", "散点"]), ("heatmap", ["heatmap", "heat map", "热图"]), ("line", ["line", "curve", "折线", "曲线", "trend"]),
    ("rheology", ["viscosity", "modulus", "rheolog", "流变", "g'", "g''"]), ("spectrum", ["spectrum", "spectra", "光谱", "ir ", "ftir", "raman"]),
]
#: Classes of objects by words of a caption, then by channel, then by words again.
OBJECT_WORDS = [("pore", ["pore"]), ("cell", ["cell", "cells", "bacteria", "nuclei"]), ("carbonate_deposit", ["carbonate"]), ("particle", ["particle", "nanoparticle", "bead"]), ("fiber", ["fiber", "fibril", "filament"])]
OBJECT_CHANNELS = [("nucleus", ["DAPI"]), ("target_signal", ["FITC", "GFP"]), ("target_signal", ["Cy5", "Cy3"])]
#: Image types by strong words of a caption, with how sure they are.
IMAGE_WORDS = [
    ("western_blot", ["western blot", "immunoblot", "western blotting"], 0.85), ("gel_image", ["sds-page", "gel electrophoresis", "sds page"], 0.8), ("sem_tem", ["sem image", "sem micrograph", "sem microphotograph"], 0.85), ("sem_tem", ["tem image", "tem micrograph", "tem microphotograph"], 0.85),
    ("fluorescence_microscopy", ["dapi", "fitc", "immunofluorescence", "confocal microscopy"], 0.8), ("microscopy_quant", ["scale bar", "scalebar", "µm", "μm"], 0.6), ("schematic", ["schematic", "workflow diagram", "mechanism diagram", "示意", "流程"], 0.75),
    ("spectrum_curve", ["ftir", "xrd pattern", "uv-vis spectrum", "raman shift", "wavenumber"], 0.8), ("rheology_flow_curve", ["flow curve", "viscosity curve", "shear rate"], 0.7), ("rheology_strain_sweep", ["strain sweep", "storage modulus", "loss modulus", "g'", "g''", "g′"], 0.75),
]
#: Words and signs that signal a result, and sections that hold results.
RESULT_SIGNAL = r"(?i)\b(achieved|achieves|outperform|outperformed|improve|improved|increase|increased|decrease|decreased|significant|accuracy|f1|auc|precision|recall|limitation|limited|conclude|conclusion|result|results)\b|[%=><±]"
RESULT_SECTION = r"(?i)\b(abstract|result|results|experiment|experiments|discussion|conclusion|limitations?)\b"
SOURCE_ORDER = ["rendered_figure_region", "extracted_image", "page_visual_snapshot", "fallback_snapshot"]
NO_EXACT_VALUES = "未进行精确数值还原"


def cascade(value: Column, rules: list[tuple[str, list[str]]], other: str | Column) -> Column:
    out = F.when(evidence.has_any(value, rules[0][1]), rules[0][0])
    return reduce(lambda c, rule: c.when(evidence.has_any(value, rule[1]), rule[0]), rules[1:], out).otherwise(other)


def object_class(caption: Column, channel: Column) -> Column:
    low = F.lower(F.coalesce(caption, F.lit("")))
    by_channel = reduce(lambda c, rule: c.when(channel.isin(rule[1]), rule[0]), OBJECT_CHANNELS[1:], F.when(channel.isin(OBJECT_CHANNELS[0][1]), OBJECT_CHANNELS[0][0]))
    return cascade(low, OBJECT_WORDS, by_channel.when(evidence.has_any(low, ["element", "eds", "mapping"]), "element_region").otherwise("unclassified_object_review"))


def file_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """``rows`` with ``unique_name``: the first of a name keeps it, each later one is numbered on until its name is free.

    Names with one stem aside from numbers at its end can meet. Where only one name of a stem repeats, the numbers are row numbers.
    Where several names of a stem meet (a.txt and a-1.txt) their rows are folded in order, as the rule is one row after the other.
    """
    pattern = r"^(.+?)(\.[^.]*)?$"
    stem, end = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)
    cols = rows.columns
    keyed = rows.withColumns({"_base": F.concat(F.regexp_replace(stem, r"(-\d+)+$", ""), F.lit("/"), end), "_stem": stem, "_end": end})
    names = keyed.groupBy("_base", name).agg(F.count("*").alias("_n")).groupBy("_base").agg(F.sum("_n").alias("_n"), F.count("*").alias("_d"))
    meet = names.where("_n > _d and _d > 1").select("_base")
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    plain = keyed.join(meet, "_base", "left_anti").withColumn("_i", n)
    plain = plain.withColumn("unique_name", F.when(F.col("_i") == 0, F.col(name)).otherwise(F.concat("_stem", F.lit("-"), F.col("_i").cast("string"), "_end")))
    many = keyed.join(meet, "_base", "left_semi").groupBy("_base").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in cols if c != order], "_stem", "_end"))).alias("_r"))
    step = f"""aggregate(_r, cast(array() as array<string>), (used, x) -> array_append(used, if(not array_contains(used, x.`{name}`), x.`{name}`,
        element_at(filter(transform(sequence(1, size(used) + 1), i -> concat(x._stem, '-', i, x._end)), c -> not array_contains(used, c)), 1))))"""
    done = many.select("_r", F.expr(step).alias("_u")).select(F.posexplode("_r").alias("_i", "_x"), "_u").select("_x.*", F.get("_u", F.col("_i")).alias("unique_name"))
    return plain.select(*cols, "unique_name").unionByName(done.select(*cols, "unique_name"))


def semantic_chunks(chunks: DataFrame, query_vector: DataFrame, query: str, k: int, least: float, doc: int | None = None) -> DataFrame:
    """The k chunks nearest to a query with a score of ``least`` or more; where there is none, the first that hold its words."""
    own = chunks if doc is None else chunks.where(F.col("doc_id") == doc)
    near = own.crossJoin(F.broadcast(query_vector)).select("vec_id", numbers.cosine(F.col("embedding"), F.col("q")).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "vec_id").limit(k)
    words = own.where(F.contains(F.lower("text"), F.lit(query.strip().lower()))).select("vec_id", F.lit(1.0).alias("score")).orderBy("vec_id").limit(k)
    found = near.agg((F.count("*") == 0).alias("none"))
    return near.unionByName(words.crossJoin(F.broadcast(found)).where("none").drop("none"))


def ranked_results(results: DataFrame, query: str, k: int) -> DataFrame:
    """Of the newest 3k results with any term of the query in a column, the k most relevant over all columns.

    ``results``: id, created_at and the text columns title, query, field, content, evidence.
    """
    terms = text.query_terms(F.lit(query))
    cols = ["title", "query", "field", "content", "evidence"]
    any_ = F.exists(terms, lambda t: reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), t) for c in cols)))
    newest = results.where((F.size(terms) == 0) | any_).orderBy(F.desc("created_at"), "id").limit(3 * k)
    return newest.select("id", text.relevance(F.concat_ws(" ", *cols), terms).alias("score"), "created_at").orderBy(F.desc("score"), F.desc("created_at"), "id").limit(k).drop("created_at")


def claim_rows(chunks: DataFrame, most: int = 4) -> DataFrame:
    """(id, pos, claim, claim_type, confidence): up to ``most`` claim sentences of each chunk (id, text, section).

    In a section of results every sentence of 24 to 500 characters counts, elsewhere one with a signal of a result. With a number in
    such a section a claim is of high confidence, with a signal of medium. A sentence that a chunk repeats counts once.
    """
    relevant = F.coalesce(F.col("section").rlike(RESULT_SECTION), F.lit(False))
    parts = F.filter(text.claim_sentences(F.coalesce("text", F.lit(""))), lambda s: F.length(s).between(24, 500) & (relevant | s.rlike(RESULT_SIGNAL)))
    first = F.slice(parts, 1, most)
    once = F.filter(first, lambda s, i: F.array_position(F.transform(first, F.lower), F.lower(s)) == i + 1)
    rows = chunks.select("id", relevant.alias("r"), F.posexplode(once).alias("pos", "claim"))
    sure = F.when(F.col("r") & F.col("claim").rlike(r"\d|%"), "high").when(F.col("claim").rlike(RESULT_SIGNAL), "medium").otherwise("low")
    return rows.select("id", F.col("pos").cast("long").alias("pos"), "claim", text.claim_type(F.col("claim")).alias("claim_type"), sure.alias("confidence"))


def shown_assets(assets: DataFrame) -> DataFrame:
    """(id, doc): the visuals to show for each document.

    Where crops of a parser are there, only these. Else all but older objects that a rendered region of the same page and label covers,
    page pictures of pages with anything finer, and fallbacks. ``assets``: id, doc, page, kind, source, label.
    """
    crop = F.col("source").startswith("mineru_")
    rows = assets.where(F.col("kind").isin("figure", "chart", "image")).withColumn("_crops", F.bool_or(crop).over(Window.partitionBy("doc")))
    page = F.col("source").isin("page_visual_snapshot")
    label = F.regexp_replace(F.lower(F.coalesce("label", F.lit(""))), r"\s+", "")
    own = Window.partitionBy("doc", "page", "_key")
    rows = rows.withColumn("_key", label).withColumn("_region", (F.col("_key") != "") & F.bool_or(F.col("source") == "rendered_figure_region").over(own))
    rows = rows.withColumn("_fine", F.bool_or((F.col("kind") == "figure") & ~page).over(Window.partitionBy("doc", "page")))
    hidden = (F.col("source") == "extracted_image") & F.col("_region") | page & F.col("_fine") | (F.col("source") == "fallback_snapshot")
    return rows.where((F.col("_crops") & crop) | (~F.col("_crops") & ~hidden)).select("id", "doc")


def note_chunks(notes: DataFrame) -> DataFrame:
    """(id, chunk_index, text, char_start, char_end, token_count): pieces of a note and where each starts in it, looked for from the end of the last.

    A fold over a note's pieces; what is not found as it stands starts where the last one ended.
    """
    pieces = notes.select("id", "body", note_pieces(F.col("body")).alias("p"))
    step = """aggregate(p, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,text:string>>)), (s, x) -> transform(array(if(locate(x, body, s.at + 1) > 0, locate(x, body, s.at + 1) - 1, s.at)), a ->
        named_struct('at', a + length(x), 'out', array_append(s.out, named_struct('start', a, 'text', x))))[0], s -> s.out)"""
    rows = pieces.select("id", F.posexplode(F.expr(step)).alias("chunk_index", "c"))
    return rows.select("id", "chunk_index", "c.text", F.col("c.start").alias("char_start"), (F.col("c.start") + F.length("c.text")).alias("char_end"), F.size(F.filter(F.split("c.text", r"\s+"), lambda w: w != "")).alias("token_count"))


def caption_blocks(labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, page, label, block): the block of a page that is a label's caption, by how it starts, what follows and how long it is.

    An equi join on the page and the label without white space, then the best of each. ``blocks``: doc, page, block, text.
    """
    pattern = r"(?i)((?:fig\.?|figure|table)\s*\d+)"
    key = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", ""), r"^fig\.?(?=\d)", "figure")
    found = F.regexp_extract("text", pattern, 1)
    at = F.instr("text", found) - 1
    after = F.substring(F.col("text"), at + F.length(found) + 1, F.length("text"))
    rows = blocks.where(found != "").withColumns({"key": key(found), "_at": at, "_after": after})
    like = (F.length(F.trim("_after")) >= 15) & (F.col("_at") <= 50) & ~F.substring(F.trim("_after"), 1, 1).isin(")", "]", ",", ";")
    rows = rows.where(like).withColumn("_score", F.when(F.col("_at") == 0, 4.0).when(F.col("_at") <= 30, 2.0).otherwise(0.0) + F.when(F.substring("_after", 1, 1).isin(".", ":", "：", "|", "-"), 1.0).otherwise(0.0) + F.when(F.length("text") >= 35, 1.0).otherwise(0.0) + F.when(F.col("_at") <= 40, 0.5).otherwise(0.0))
    best = labels.withColumn("key", key(F.col("label"))).join(rows.select("doc", "page", "key", "block", "_score"), ["doc", "page", "key"])
    return best.groupBy("doc", "page", "label").agg(F.max_by("block", F.struct("_score", -F.col("block"))).alias("block"))


def outbox(paths: DataFrame, kept: DataFrame) -> DataFrame:
    """(path): files to be removed with deleted rows: each once, none that is an address or that a row that stays still uses."""
    return paths.where("path is not null and path <> '' and source_type <> 'bookmark'").select("path").distinct().join(kept.select("path"), "path", "left_anti")


def attempted(jobs: DataFrame, failed: Column, now: Column, delay: int) -> DataFrame:
    """Jobs after a try: done, or one attempt more and due again after a delay, failed for good at their last."""
    tries = F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts"))
    status = F.when(~failed, "done").when(tries >= F.col("max_attempts"), "failed").otherwise("pending")
    return jobs.withColumns({"attempts": tries, "status": status, "next_run": F.when(failed, now + F.make_interval(secs=F.lit(delay))).otherwise(F.col("next_run"))})


# --- queries ---
_MODE = "CASE doc_id % 8 WHEN 0 THEN 'auto' WHEN 1 THEN 'plain_text' WHEN 2 THEN 'pdf_text' WHEN 3 THEN 'scanned_pdf_ocr' WHEN 4 THEN 'image_ocr' WHEN 5 THEN 'markdown_notes' WHEN 6 THEN 'table_image_ocr' ELSE 'basic_file_parser' END AS mode, CASE doc_id % 9 WHEN 0 THEN 'PDF' WHEN 1 THEN 'txt' WHEN 2 THEN 'text' WHEN 3 THEN 'image' WHEN 4 THEN 'markdown' WHEN 5 THEN 'md' WHEN 6 THEN 'epub' WHEN 7 THEN 'docx' ELSE 'video' END AS kind"


@BOOK.add(f"""SELECT doc_id, CASE mode WHEN 'auto' THEN CASE lower(kind) WHEN 'pdf' THEN 'pdf_text_with_ocr_fallback' WHEN 'image' THEN 'image_ocr' WHEN 'markdown' THEN 'markdown_structure' WHEN 'md' THEN 'markdown_structure' WHEN 'epub' THEN 'epub_reader_preview' WHEN 'docx' THEN 'download_preview_only' WHEN 'video' THEN 'video_preview' ELSE 'plain_text' END
WHEN 'plain_text' THEN CASE WHEN kind IN ('txt','text') THEN 'plain_text' ELSE 'rejected' END WHEN 'pdf_text' THEN CASE WHEN kind = 'PDF' THEN 'pdf_text_with_ocr_fallback' ELSE 'rejected' END WHEN 'scanned_pdf_ocr' THEN CASE WHEN kind = 'PDF' THEN 'ocr_first_pdf' ELSE 'rejected' END
WHEN 'image_ocr' THEN CASE WHEN kind = 'image' THEN 'image_ocr' ELSE 'rejected' END WHEN 'markdown_notes' THEN CASE WHEN kind IN ('markdown','md') THEN 'markdown_structure' ELSE 'rejected' END WHEN 'table_image_ocr' THEN CASE WHEN kind = 'image' THEN 'table_image_ocr' ELSE 'rejected' END
ELSE CASE WHEN kind IN ('PDF','txt','text','markdown','md') THEN 'basic_file_parser' ELSE 'rejected' END END AS strategy FROM (SELECT doc_id, {_MODE} FROM documents)""")
def prj9_strategy(spark, sf_dir):
    """Modes and the source types they take, as a table of rules; what has no rule is rejected."""
    from docloom.operators.charts import _columns

    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", *_columns(f"SELECT {_MODE} FROM x")).withColumn("kind", F.lower("kind"))
    return rows.join(F.broadcast(spark.createDataFrame(MODES, "mode string, kind string, strategy string")), ["mode", "kind"], "left").select("doc_id", F.coalesce("strategy", F.lit("rejected")).alias("strategy"))


@BOOK.add("""WITH j AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN NULL ELSE 'f' || event_id END AS file_name, CASE WHEN event_id % 3 = 0 THEN '' ELSE 't' || event_id END AS title, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS d FROM events), c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS name FROM customer)
SELECT event_id, coalesce(nullif(file_name, ''), nullif(name, ''), nullif(title, ''), CASE WHEN d IS NOT NULL THEN 'Document ' || d ELSE event_type END) AS file_name FROM j LEFT JOIN c ON d = c_custkey""")
def prj2_task_names(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN NULL ELSE concat('f', event_id) END AS file_name", "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('t', event_id) END AS title", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS d")
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")).alias("name"))
    made = F.when(F.col("d").isNotNull(), F.concat(F.lit("Document "), F.col("d").cast("string"))).otherwise(F.col("event_type"))
    return jobs.join(docs, F.col("d") == F.col("c_custkey"), "left").select("event_id", text.coalesce_blank(F.col("file_name"), F.col("name"), F.col("title"), made).alias("file_name"))


@BOOK.add(f"""WITH {cte('a', ASSETS)}, k AS (SELECT *, coalesce(json_extract_string(metadata, '$.source'), '') AS src, json_extract_string(metadata, '$.visual_role') AS vr FROM a), r AS (SELECT *, CASE WHEN coalesce(vr, '') <> '' THEN vr WHEN src = 'extracted_image' THEN 'image_object' WHEN src = 'page_visual_snapshot' THEN 'page_evidence' WHEN asset_type = 'figure' THEN 'figure_candidate' ELSE coalesce(nullif(src, ''), 'unknown') END AS role FROM k)
SELECT id, 'Figure ' || id || ' [asset:' || id || ']' AS figure_id, role, CASE WHEN src = 'rendered_figure_region' OR role = 'figure_candidate' THEN 'Figure candidate produced from caption-guided page crop.' WHEN src = 'page_visual_snapshot' OR role = 'page_evidence' THEN 'Page-level visual evidence; not a complete figure.' WHEN src = 'extracted_image' OR role = 'image_object' THEN 'PDF image object; it may be a figure panel or image fragment.' WHEN src = 'fallback_snapshot' OR role = 'fallback_snapshot' THEN 'Fallback snapshot; lowest-priority visual evidence.' ELSE '' END AS note FROM r""")
def prj15_figure_info(spark, sf_dir):
    rows = derived.rows(spark, sf_dir, ASSETS)
    source, stated = F.coalesce(F.get_json_object("metadata", "$.source"), F.lit("")), F.get_json_object("metadata", "$.visual_role")
    role = F.when(F.coalesce(stated, F.lit("")) != "", stated).when(source == "extracted_image", "image_object").when(source == "page_visual_snapshot", "page_evidence").when(F.col("asset_type") == "figure", "figure_candidate").otherwise(text.coalesce_blank(source, F.lit("unknown")))
    notes = [("rendered_figure_region", "figure_candidate", "Figure candidate produced from caption-guided page crop."), ("page_visual_snapshot", "page_evidence", "Page-level visual evidence; not a complete figure."), ("extracted_image", "image_object", "PDF image object; it may be a figure panel or image fragment."), ("fallback_snapshot", "fallback_snapshot", "Fallback snapshot; lowest-priority visual evidence.")]
    note = reduce(lambda c, n: c.when((source == n[0]) | (role == n[1]), n[2]), notes[1:], F.when((source == notes[0][0]) | (role == notes[0][1]), notes[0][2])).otherwise("")
    return rows.select("id", F.format_string("Figure %d [asset:%d]", "id", "id").alias("figure_id"), role.alias("role"), note.alias("note"))


@BOOK.add("""WITH c AS (SELECT p_partkey AS id, CASE p_size % 8 WHEN 0 THEN 'Framework of the pipeline' WHEN 1 THEN 'Workflow' WHEN 2 THEN 'A histogram with trend' WHEN 3 THEN 'Growth curve' WHEN 4 THEN 'UMAP of cells' WHEN 5 THEN 'Colony of beads' WHEN 6 THEN ' ' ELSE 'Storage modulus of film' END AS cap, CASE WHEN p_size % 3 = 0 THEN 'DAPI' ELSE 'none' END AS ch FROM part)
SELECT id, CASE cap WHEN 'Framework of the pipeline' THEN 'architecture_diagram' WHEN 'Workflow' THEN 'flowchart' WHEN 'A histogram with trend' THEN 'bar_chart' WHEN 'Growth curve' THEN 'line_chart' WHEN 'UMAP of cells' THEN 'scatter_plot' WHEN 'Colony of beads' THEN 'colony_image' WHEN ' ' THEN 'unknown' ELSE 'material_image' END AS figure_type,
CASE cap WHEN 'A histogram with trend' THEN 'bar' WHEN 'Framework of the pipeline' THEN 'line' WHEN 'Growth curve' THEN 'line' WHEN 'Storage modulus of film' THEN 'rheology' ELSE 'unknown' END AS chart_type, CASE cap WHEN 'UMAP of cells' THEN 'cell' WHEN 'Colony of beads' THEN 'particle' ELSE CASE WHEN ch = 'DAPI' THEN 'nucleus' ELSE 'unclassified_object_review' END END AS object_class,
CASE cap WHEN 'Storage modulus of film' THEN 'rheology_strain_sweep' ELSE 'unknown' END AS image_type FROM c""")
def str23_caption_cascades(spark, sf_dir):
    """Four classes of a caption by their word lists."""
    said = F.element_at(F.array(*(F.lit(s) for s in ("Framework of the pipeline", "Workflow", "A histogram with trend", "Growth curve", "UMAP of cells", "Colony of beads", " ", "Storage modulus of film"))), (F.col("p_size") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), said.alias("c"), F.when(F.col("p_size") % 3 == 0, "DAPI").otherwise("none").alias("ch"))
    c = F.col("c")
    other = F.when(F.trim(c) != "", "ordinary_figure").otherwise("unknown")
    return rows.select("id", cascade(c, FIGURE_TYPES, other).alias("figure_type"), cascade(c, CHART_WORDS, "unknown").alias("chart_type"), object_class(c, F.col("ch")).alias("object_class"), cascade(c, [(n, w) for n, w, _ in IMAGE_WORDS], "unknown").alias("image_type"))


@BOOK.add(f"""WITH {cte('t', TABLES)} SELECT id, coalesce(nullif(label, ''), 'Table ' || id) || CASE WHEN contains(content, '| Name') THEN ' reports Name, Size.' ELSE ' contains extracted table-like evidence.' END AS summary, CASE WHEN contains(content, '| Name') THEN trim(split_part(split_part(content, chr(10), 3), '|', 2)) || ' | ' || trim(split_part(split_part(content, chr(10), 3), '|', 3)) ELSE '' END AS key_finding FROM t""")
def doc12_table_summary(spark, sf_dir):
    """What a table reports by its headers, and its first row as the key finding."""
    cells = markdown_cells(F.col("content"))
    heads, first = F.get(cells, F.lit(0)), F.get(cells, F.lit(1))
    name = text.coalesce_blank(F.col("label"), F.concat(F.lit("Table "), F.col("id").cast("string")))
    said = F.when(F.size(heads) > 0, F.concat(F.lit(" reports "), F.array_join(F.slice(heads, 1, 5), ", "), F.lit("."))).otherwise(" contains extracted table-like evidence.")
    return derived.rows(spark, sf_dir, TABLES).select("id", F.concat(name, said).alias("summary"), F.coalesce(F.array_join(F.slice(first, 1, 5), " | "), F.lit("")).alias("key_finding"))


_CHUNKS = """c AS (SELECT vec_id, vec_id % 200 AS doc_id, e.embedding, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id % 200)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 200).alias("doc_id")).join(docs, "doc_id")


@BOOK.add(f"""WITH {_CHUNKS}, s AS (SELECT vec_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 3)) AS score FROM c)
SELECT 'near' AS run, vec_id, round(score, 6) AS score FROM (SELECT * FROM s WHERE score >= 0.3 ORDER BY score DESC, vec_id LIMIT 10) UNION ALL SELECT 'words', vec_id, 1.0 FROM (SELECT vec_id FROM c WHERE contains(lower(text), 'license') ORDER BY vec_id LIMIT 10)""")
def ret4_semantic_chunks(spark, sf_dir):
    """Chunks near a query above a threshold; with one that nothing reaches, those that hold its words."""
    chunks = _chunks(spark, sf_dir)
    query = table(spark, sf_dir, "embeddings").where("vec_id = 3").select(F.col("embedding").alias("q"))
    near, words = (semantic_chunks(chunks, query, " License", 10, least).select(F.lit(name).alias("run"), "vec_id", F.round("score", 6).alias("score")) for name, least in (("near", 0.3), ("words", 1.5)))
    return near.unionByName(words)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("query"), F.col("event_type").alias("field"), F.col("props").alias("content"), F.lit("").alias("evidence"))


_RANKED = """h AS (SELECT event_id AS id, ts, lower(c_name || ' ' || c_mktsegment || ' ' || event_type || ' ' || props) AS hay FROM events JOIN customer ON user_id = c_custkey), n AS (SELECT *, (CASE WHEN contains(hay, 'click') THEN 2.5::DOUBLE ELSE 0 END) + (CASE WHEN contains(hay, 'building') THEN 3.0::DOUBLE ELSE 0 END) + (CASE WHEN contains(hay, '77') THEN 1.0::DOUBLE ELSE 0 END) AS score FROM h),
t AS (SELECT * FROM n WHERE score > 0 ORDER BY ts DESC, id LIMIT 60), k AS (SELECT id, score FROM t ORDER BY score DESC, ts DESC, id LIMIT 20)"""


@BOOK.add(f"WITH {_RANKED} SELECT id, score FROM k")
def ret6_ranked_results(spark, sf_dir):
    return ranked_results(_results(spark, sf_dir), "click building 77", 20)


@BOOK.add(f"""WITH {_RANKED}, d AS (SELECT doc_id AS id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 5) SELECT 'chunk' AS source_type, id, score FROM d UNION ALL SELECT 'extraction_result', id, score FROM k""")
def ret7_sources(spark, sf_dir):
    """What an answer is built on: chunks, then extraction results, in one bag."""
    hits = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("license"))).orderBy("doc_id").limit(5).select(F.lit("chunk").alias("source_type"), F.col("doc_id").alias("id"), F.lit(1.0).alias("score"))
    return hits.unionByName(ranked_results(_results(spark, sf_dir), "click building 77", 20).select(F.lit("extraction_result").alias("source_type"), "id", "score"))


@BOOK.add("""SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings WHERE list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 7)) > 0.2
ORDER BY list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 7)) DESC, vec_id LIMIT 25""")
def join22_query_vector(spark, sf_dir):
    """One query against all vectors, the best of them in order (SRT-6)."""
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search(vectors, vectors.where("vec_id = 7").select(F.col("embedding").alias("q")), 25, 0.2).select("vec_id", F.round("score", 6).alias("score"))


@BOOK.add("""SELECT doc_id, CAST(len(list_filter(['license','token'], lambda t: contains(lower(text), t))) AS BIGINT) AS hits FROM documents LEFT JOIN labels USING (doc_id) ORDER BY hits DESC, coalesce(quality, 0) = 1 DESC, doc_id DESC LIMIT 8""")
def srt5_top_claims(spark, sf_dir):
    terms = F.array(F.lit("license"), F.lit("token"))
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.size(F.filter(terms, lambda t: F.contains(F.lower(F.col("text")), t))).cast("long").alias("hits"), (F.coalesce("quality", F.lit(0)) == 1).alias("high")).orderBy(F.desc("hits"), F.desc("high"), F.desc("doc_id")).limit(8).drop("high")


@BOOK.add(r"""WITH s AS (SELECT doc_id, source, trim(regexp_replace(x, '\s+', ' ', 'g')) AS claim, i FROM (SELECT doc_id, source, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT doc_id, source, regexp_split_to_array(regexp_replace(text, '([.!?。！？])\s+', '\1␞', 'g'), '␞|\n+') AS l FROM documents))),
g AS (SELECT *, source = 'src1' AS r, regexp_matches(claim, '(?i)\b(achieved|achieves|outperform|outperformed|improve|improved|increase|increased|decrease|decreased|significant|accuracy|f1|auc|precision|recall|limitation|limited|conclude|conclusion|result|results)\b|[%=><±]') AS sig FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g WHERE length(claim) BETWEEN 24 AND 500 AND (r OR sig)), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(claim) ORDER BY i) AS d FROM f WHERE n <= 4)
SELECT doc_id AS id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, claim, CASE WHEN regexp_matches(lower(claim), 'limitation|limited|fail|cannot') THEN 'limitation' WHEN regexp_matches(lower(claim), 'outperform|better than|compared|versus|vs\.') THEN 'comparison' WHEN regexp_matches(lower(claim), 'method|approach|framework|model') THEN 'method' WHEN regexp_matches(lower(claim), 'conclude|conclusion|therefore') THEN 'conclusion' ELSE 'result' END AS claim_type,
CASE WHEN r AND regexp_matches(claim, '[0-9]|%') THEN 'high' WHEN sig THEN 'medium' ELSE 'low' END AS confidence FROM o WHERE d = 1""")
def doc10_claim_rows(spark, sf_dir):
    """Claims by the signals of results and by section (FLT-21), with type and confidence, each once in its document."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("source") == "src1", "3. Results and discussion").otherwise("Methods").alias("section"))
    return claim_rows(rows)


@BOOK.add("""WITH a AS (SELECT p_partkey AS id, p_partkey % 25 AS doc, p_size % 6 AS page, CASE WHEN p_partkey % 9 = 0 THEN 'table' ELSE 'figure' END AS kind, CASE WHEN p_partkey % 25 = 3 AND p_size % 2 = 0 THEN 'mineru_chart' ELSE ['extracted_image','rendered_figure_region','page_visual_snapshot','fallback_snapshot'][p_size % 4 + 1] END AS source, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'fig ' || p_size % 5 END AS label FROM part),
f AS (SELECT * FROM a WHERE kind = 'figure'), w AS (SELECT *, bool_or(source = 'mineru_chart') OVER (PARTITION BY doc) AS crops, label <> '' AND bool_or(source = 'rendered_figure_region') OVER (PARTITION BY doc, page, label) AS region, bool_or(source <> 'page_visual_snapshot') OVER (PARTITION BY doc, page) AS fine FROM f)
SELECT id, doc FROM w WHERE CASE WHEN crops THEN source = 'mineru_chart' ELSE NOT ((source = 'extracted_image' AND region) OR (source = 'page_visual_snapshot' AND fine) OR source = 'fallback_snapshot') END""")
def set7_shown_assets(spark, sf_dir):
    source = F.when((F.col("p_partkey") % 25 == 3) & (F.col("p_size") % 2 == 0), "mineru_chart").otherwise(F.element_at(F.array(*(F.lit(s) for s in ("extracted_image", "rendered_figure_region", "page_visual_snapshot", "fallback_snapshot"))), (F.col("p_size") % 4 + 1).cast("int")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 25).alias("doc"), (F.col("p_size") % 6).alias("page"), F.when(F.col("p_partkey") % 9 == 0, "table").otherwise("figure").alias("kind"), source.alias("source"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("Fig "), (F.col("p_size") % 5).cast("string"))).alias("label"))
    return shown_assets(rows)


@BOOK.add("""SELECT doc_id AS id, unnest([0, 1]) AS chunk_index, unnest([0, 405]) AS char_start, unnest([403, 1205]) AS char_end, unnest([2, 1]) AS token_count FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 0, 2, 5, 1 FROM documents WHERE doc_id % 2 = 1""")
def doc18_note_chunks(spark, sf_dir):
    """Notes as chunks with their places (WIN-15): packed paragraphs, and one of a single short paragraph."""
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.repeat(F.lit("a"), 400), F.lit("\n\nb\n\n"), F.repeat(F.lit("c"), 800))).otherwise("\n\nabc\n")
    return note_chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), body.alias("body"))).drop("text")


@BOOK.add(r"""SELECT c_custkey, CASE WHEN n = 0 THEN f ELSE regexp_extract(f, '^(.*)\.', 1) || '-' || n || '.txt' END AS unique_name FROM (SELECT c_custkey, f, row_number() OVER (PARTITION BY f ORDER BY c_custkey) - 1 AS n FROM (SELECT c_custkey, c_mktsegment || '.txt' AS f FROM customer))""")
def snk12_unique_names(spark, sf_dir):
    return file_names(table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(".txt")).alias("f")), "f", "c_custkey").drop("f")


@BOOK.add("""WITH b AS (SELECT p_partkey % 20 AS doc, p_size % 4 AS page, p_partkey AS block, CASE p_partkey % 4 WHEN 0 THEN 'Fig. 2: growth of all of the cells over time' WHEN 1 THEN 'As seen in Figure 2 the cells grow quickly' WHEN 2 THEN 'Figure 2' ELSE 'Table 1 sizes of each of the parts' END AS text FROM part),
s AS (SELECT *, CASE block % 4 WHEN 0 THEN 6.5 + 0 WHEN 1 THEN 3.5 ELSE 0 END AS score, CASE block % 4 WHEN 3 THEN 'Table 1' ELSE 'Figure 2' END AS label FROM b WHERE block % 4 <> 2) SELECT doc, page, label, arg_max(block, (score, -block)) AS block FROM s GROUP BY doc, page, label""")
def join25_caption_blocks(spark, sf_dir):
    said = F.element_at(F.array(*(F.lit(s) for s in ("Fig. 2: growth of all of the cells over time", "As seen in Figure 2 the cells grow quickly", "Figure 2", "Table 1 sizes of each of the parts"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    blocks = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("doc"), (F.col("p_size") % 4).alias("page"), F.col("p_partkey").alias("block"), said.alias("text"))
    labels = blocks.select("doc", "page").distinct().withColumn("label", F.explode(F.array(F.lit("Figure 2"), F.lit("Table 1"))))
    return caption_blocks(labels, blocks)


@BOOK.add(f"""WITH {cte('a', ASSETS)}, p AS (SELECT doc_id, 'doc/' || doc_id // 3 AS path, CASE WHEN source = 'src0' THEN 'bookmark' ELSE 'pdf' END AS source_type, lang = 'fr' AS deleted FROM documents), g AS (SELECT path, source_type FROM p WHERE deleted UNION ALL SELECT file_path, 'pdf' FROM a WHERE doc_id IN (SELECT doc_id FROM p WHERE deleted)), k AS (SELECT path FROM p WHERE NOT deleted)
SELECT DISTINCT path FROM g WHERE coalesce(path, '') <> '' AND source_type <> 'bookmark' AND path NOT IN (SELECT path FROM k)""")
def dml6_hard_delete_outbox(spark, sf_dir):
    """Files of deleted documents and of their assets, each once, without bookmarks and without those still in use."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), F.expr("doc_id div 3").cast("string")).alias("path"), F.when(F.col("source") == "src0", "bookmark").otherwise("pdf").alias("source_type"), (F.col("lang") == "fr").alias("deleted"))
    gone = docs.where("deleted")
    assets = derived.rows(spark, sf_dir, ASSETS).join(gone, "doc_id", "left_semi").select(F.col("file_path").alias("path"), F.lit("pdf").alias("source_type"))
    return outbox(gone.select("path", "source_type").unionByName(assets), docs.where("not deleted"))


@BOOK.add("""SELECT event_id, CASE WHEN event_type = 'error' THEN event_id % 4 + 1 ELSE event_id % 4 END AS attempts, CASE WHEN event_type <> 'error' THEN 'done' WHEN event_id % 4 + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN event_type = 'error' THEN TIMESTAMP '2024-02-01 00:05:00' ELSE ts END AS next_run FROM events""")
def stm7_outbox_attempts(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 4).alias("attempts"), F.lit(3).alias("max_attempts"), F.lit("processing").alias("status"), F.col("ts").alias("next_run"))
    return attempted(jobs, F.col("event_type") == "error", F.lit("2024-02-01").cast("timestamp_ntz"), 300).select("event_id", "attempts", "status", "next_run")


@BOOK.add("""SELECT 'document' AS kind, doc_id AS id, 'pending' AS state FROM documents UNION ALL SELECT 'job', doc_id, 'queued' FROM documents UNION ALL SELECT 'event', doc_id, 'uploaded' FROM documents""")
def dml1_insert_rows(spark, sf_dir):
    """One batch of uploads as the rows of three tables: the document, its job and the event; ``foreachBatch`` writes them together."""
    batch = table(spark, sf_dir, "documents").select("doc_id")
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("state")) for k, s in (("document", "pending"), ("job", "queued"), ("event", "uploaded")))))
    return batch.select(F.col("doc_id").alias("id"), rows.alias("r")).select("r.kind", "id", "r.state")


@BOOK.add("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' WHEN 3 THEN 'done' ELSE 'deleted' END AS a, CASE o_orderkey % 4 WHEN 0 THEN 'processing' WHEN 1 THEN 'done' WHEN 2 THEN 'deleted' ELSE 'pending' END AS b FROM orders)
SELECT o_orderkey, (a, b) IN (('pending','processing'),('processing','done'),('processing','failed'),('failed','pending'),('failed','processing')) OR (b = 'deleted') AS allowed, CASE WHEN (a, b) IN (('pending','processing'),('processing','done'),('processing','failed'),('failed','pending'),('failed','processing')) OR (b = 'deleted') THEN b ELSE a END AS status FROM t""")
def dml2_guarded_transition(spark, sf_dir):
    """Changes of state along the allowed edges; the others are reported and change nothing."""
    edges = spark.createDataFrame([("pending", "processing"), ("processing", "done"), ("processing", "failed"), ("failed", "pending"), ("failed", "processing"), *((s, "deleted") for s in ("pending", "processing", "failed", "done", "deleted"))], "a string, b string").withColumn("ok", F.lit(True))
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' WHEN 3 THEN 'done' ELSE 'deleted' END AS a", "CASE o_orderkey % 4 WHEN 0 THEN 'processing' WHEN 1 THEN 'done' WHEN 2 THEN 'deleted' ELSE 'pending' END AS b")
    return rows.join(F.broadcast(edges), ["a", "b"], "left").select("o_orderkey", F.coalesce("ok", F.lit(False)).alias("allowed"), F.when(F.col("ok"), F.col("b")).otherwise(F.col("a")).alias("status"))


@BOOK.add("""SELECT doc_id, CASE WHEN source = 'src1' AND lang = 'en' THEN true WHEN source = 'src2' THEN false ELSE lang = 'de' END AS is_deleted, (source = 'src1' AND lang = 'en' AND NOT lang = 'de') OR (source = 'src2' AND lang = 'de') AS changed FROM documents""")
def dml5_delete_and_restore(spark, sf_dir):
    """A guarded batch of deletions and one of restorations, and which rows they change."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("lang") == "de").alias("was"))
    drop, back = (F.col("source") == "src1") & (F.col("lang") == "en") & ~F.col("was"), (F.col("source") == "src2") & F.col("was")
    return rows.select("doc_id", F.when(drop, True).when(back, False).otherwise(F.col("was")).alias("is_deleted"), (drop | back).alias("changed"))


@BOOK.add("""WITH f AS (SELECT p_partkey AS id, 'Figure ' || p_size AS label FROM part), m AS (SELECT 'Figure ' || s_suppkey AS label FROM supplier) SELECT 'asked' AS task, label FROM m UNION ALL SELECT DISTINCT '图表完整数据', label FROM f WHERE label NOT IN (SELECT label FROM m)""")
def ext13_figure_tasks(spark, sf_dir):
    """Every figure with a label gets a task: those asked for, and one for all visible data for each of the others."""
    asked = table(spark, sf_dir, "supplier").select(F.lit("asked").alias("task"), F.concat(F.lit("Figure "), F.col("s_suppkey").cast("string")).alias("label"))
    figures = table(spark, sf_dir, "part").select(F.concat(F.lit("Figure "), F.col("p_size").cast("string")).alias("label")).distinct()
    return asked.unionByName(figures.join(asked, "label", "left_anti").select(F.lit("图表完整数据").alias("task"), "label"))


@BOOK.add(f"""WITH {cte('i', ITEMS)}, t AS (SELECT id, 'text' AS branch, CASE WHEN id % 9 = 0 THEN 0.2::DOUBLE ELSE 0.7 END AS confidence, CASE WHEN id % 9 = 0 THEN 'fallback_caption_only' ELSE 'text_extraction' END AS mode FROM i WHERE source_type IN ('text','table') AND trim(coalesce(value_text, '')) <> '' AND trim(coalesce(excerpt, '')) <> ''),
f AS (SELECT id, 'figure' AS branch, CASE id % 3 WHEN 0 THEN 0.85::DOUBLE ELSE 0.65 END AS confidence, 'chart' AS mode FROM i WHERE source_type = 'figure' AND id % 3 <> 2 AND trim(coalesce(value_text, '')) <> '' AND trim(coalesce(excerpt, '')) <> '' AND NOT contains(lower(coalesce(notes, '')), 'no visible') AND data_points IS NOT NULL),
n AS (SELECT id, 'not_found' AS branch, 0.1::DOUBLE AS confidence, 'not_found' AS mode FROM i WHERE source_type = 'caption') SELECT * FROM t UNION ALL SELECT * FROM f UNION ALL SELECT * FROM n""")
def ext15_agent_results(spark, sf_dir):
    """Results of an agent as rows: texts and figures that pass their rules, and what was not found."""
    rows = derived.rows(spark, sf_dir, ITEMS)
    worn = F.col("id") % 9 == 0
    told = rows.where(F.col("source_type").isin("text", "table") & evidence.valid_text(F.col("value_text"), F.col("excerpt"))).select("id", F.lit("text").alias("branch"), F.when(worn, 0.2).otherwise(0.7).alias("confidence"), F.when(worn, "fallback_caption_only").otherwise("text_extraction").alias("mode"))
    sure = F.try_element_at(F.create_map(*(F.lit(x) for x in ("high", 0.85, "medium", 0.65, "low", 0.4, "none", 0.15))), F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("id") % 3 + 1).cast("int")))
    seen = rows.where((F.col("source_type") == "figure") & evidence.valid_visual(F.lit(None), F.col("value_text"), F.col("excerpt"), F.col("notes"), F.col("data_points").isNotNull())).select("id", F.lit("figure").alias("branch"), sure.alias("confidence"), F.lit("chart").alias("mode")).where("confidence >= 0.5")
    none = rows.where("source_type = 'caption'").select("id", F.lit("not_found").alias("branch"), F.lit(0.1).alias("confidence"), F.lit("not_found").alias("mode"))
    return told.unionByName(seen).unionByName(none)


@BOOK.add("""WITH q AS (SELECT o_orderpriority AS g, o_orderstatus AS st, CASE WHEN o_orderkey % 3 = 0 THEN 'low;blurred' WHEN o_orderkey % 3 = 1 THEN 'blurred;' ELSE NULL END AS reason, o_totalprice >= 100000 AS review FROM orders), r AS (SELECT g, string_agg(DISTINCT x, '|' ORDER BY x) AS reasons FROM (SELECT g, unnest(string_split(reason, ';')) AS x FROM q) WHERE x <> '' GROUP BY g)
SELECT q.g AS kind, count(*) FILTER (NOT review) AS accepted, count(*) FILTER (review) AS review, string_agg(DISTINCT st, '|' ORDER BY st) AS states, any_value(r.reasons) AS reasons FROM q LEFT JOIN r ON q.g = r.g GROUP BY q.g""")
def agg15_summary_with_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "low;blurred").when(F.col("o_orderkey") % 3 == 1, "blurred;").alias("reason"), (F.col("o_totalprice") >= 100000).alias("review"))
    parts = F.array_distinct(F.flatten(F.collect_set(F.filter(F.split(F.coalesce("reason", F.lit("")), ";"), lambda x: x != ""))))
    return rows.groupBy("kind").agg(F.count_if(~F.col("review")).alias("accepted"), F.count_if("review").alias("review"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "|").alias("states"), F.array_join(F.array_sort(parts), "|").alias("reasons"))


@BOOK.add("""WITH a AS (SELECT l_returnflag AS image_type, l_linestatus AS status, CASE WHEN l_tax > 0.04 THEN 'bound' ELSE 'standard' END AS quality, 'r' || l_linenumber % 2 AS recipes, 'm' || l_suppkey % 2 AS methods, CASE WHEN l_discount > 0.05 THEN 'low' ELSE '' END AS reasons, CAST(l_quantity AS BIGINT) AS n, 'f' || lpad(l_orderkey::VARCHAR, 8, '0') || l_partkey AS file FROM lineitem)
SELECT image_type, status, quality, recipes, methods, reasons, count(*) AS images, CAST(sum(n) AS BIGINT) AS rows, array_to_string(list_slice(list_sort(list_distinct(list(file))), 1, 3), '|') AS examples FROM a GROUP BY ALL""")
def agg16_audit_six_keys(spark, sf_dir):
    """Sums by six keys, with up to three examples; the smallest names are kept while counting, so no group is gathered."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("image_type"), F.col("l_linestatus").alias("status"), F.when(F.col("l_tax") > 0.04, "bound").otherwise("standard").alias("quality"), F.concat(F.lit("r"), (F.col("l_linenumber") % 2).cast("string")).alias("recipes"), F.concat(F.lit("m"), (F.col("l_suppkey") % 2).cast("string")).alias("methods"),
                                                   F.when(F.col("l_discount") > 0.05, "low").otherwise("").alias("reasons"), F.col("l_quantity").cast("long").alias("n"), F.concat(F.lit("f"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.col("l_partkey").cast("string")).alias("file"))
    keys = ["image_type", "status", "quality", "recipes", "methods", "reasons"]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("images"), F.sum("n").alias("rows"))
    top = rows.select(*keys, "file").distinct().withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("file"))).where("k <= 3").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("file")), "|").alias("examples"))
    return sums.join(top, keys)


@BOOK.add("""SELECT doc_id, t AS tag FROM documents, (SELECT DISTINCT c_mktsegment AS t FROM customer) WHERE NOT (lang = 'fr' AND t = 'BUILDING')""")
def join21_documents_with_tags(spark, sf_dir):
    """Each document with each tag of a small table, but for links that exist."""
    tags = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tag")).distinct()
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    docs, held = rows.select("doc_id"), rows.where("lang = 'fr'").select("doc_id", F.lit("BUILDING").alias("tag"))
    return docs.crossJoin(sent(tags)).join(held, ["doc_id", "tag"], "left_anti")


@BOOK.add(r"""WITH d AS (SELECT doc_id, text, instr(lower(text), 'license') AS p, length(regexp_replace(lower(text), '\s+', '', 'g')) AS n, length(replace(regexp_replace(lower(text), '\s+', '', 'g'), 'license', '')) AS m FROM documents) SELECT doc_id, CAST((n - m) / 7 AS BIGINT) AS refs, CASE WHEN p > 0 THEN regexp_replace(substr(text, greatest(1, p - 200), least(length(text), p + 406) - greatest(1, p - 200) + 1), '^\s+|\s+$', '', 'g') ELSE '' END AS near FROM d""")
def join23_label_context(spark, sf_dir):
    """How often a label stands in a text, white space aside, and what is around its first mention."""
    label = "license"
    flat = F.regexp_replace(F.lower("text"), r"(?U)\s+", "")
    count = ((F.length(flat) - F.length(F.replace(flat, F.lit(label), F.lit("")))) / len(label)).cast("long")
    at = F.instr(F.lower("text"), label)
    start = F.greatest(F.lit(1), at - 200)
    near = text.strip(F.substring(F.col("text"), start, F.least(F.length("text"), at + len(label) - 1 + 400) - start + 1))
    return table(spark, sf_dir, "documents").select("doc_id", count.alias("refs"), F.when(at > 0, near).otherwise("").alias("near"))


@BOOK.add(f"""WITH {cte('a', ASSETS)}, s AS (SELECT id, page, coalesce(json_extract_string(metadata, '$.source'), '') AS src, lower(replace(label, ' ', '')) AS l FROM a) SELECT id FROM s ORDER BY coalesce(page, 0), CASE src WHEN 'rendered_figure_region' THEN 0 WHEN 'extracted_image' THEN 1 WHEN 'page_visual_snapshot' THEN 2 WHEN 'fallback_snapshot' THEN 3 ELSE 9 END, l, id LIMIT 40""")
def srt7_asset_order(spark, sf_dir):
    """Assets by page, rank of their source and label, and the first 40 of them."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(s) for s in SOURCE_ORDER)), F.coalesce(F.get_json_object("metadata", "$.source"), F.lit(""))), F.lit(0)) - 1, F.lit(9))
    return derived.rows(spark, sf_dir, ASSETS).orderBy(F.coalesce("page", F.lit(0)), rank, F.lower(F.regexp_replace("label", r"\s+", "")), "id").limit(40).select("id")


def embedded(rows: DataFrame, embed, column: str = "text", out: str = "embedding", batch: int = 16) -> DataFrame:
    """``rows`` with the vectors that ``embed`` gives for texts (a list of texts to a list of vectors), ``batch`` texts at a time.

    The provider is a plain function that is sent to the tasks; rows reach it in Arrow batches.
    """

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        values = texts.fillna("").tolist()
        return pd.Series([list(map(float, v)) for at in range(0, len(values), batch) for v in embed(values[at : at + batch])])

    return rows.withColumn(out, run(F.col(column)))


def whole_text_slots(texts: list[str], dim: int = 32) -> list[list[float]]:
    """One-hot vectors by the first byte of the SHA-256 of the whole text."""
    import hashlib

    out = []
    for value in texts:
        vector = [0.0] * dim
        if value.strip():
            vector[hashlib.sha256(value.encode()).digest()[0] % dim] = 1.0
        out.append(vector)
    return out


@BOOK.add("""SELECT item_id, CAST(('0x' || substr(sha256(text), 1, 2))::BIGINT % 32 AS INTEGER) AS slot, 1.0::DOUBLE AS length FROM benchmark""")
def udf1_embedding_provider(spark, sf_dir):
    """Vectors by a provider that is handed in, sixteen texts at a time."""
    rows = embedded(table(spark, sf_dir, "benchmark"), whole_text_slots)
    return rows.select("item_id", (F.array_position("embedding", F.lit(1.0)) - 1).cast("int").alias("slot"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("length"))


@BOOK.add(r"""SELECT doc_id, i AS pos FROM (SELECT doc_id, source, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT doc_id, source, regexp_split_to_array(regexp_replace(text, '([.!?。！？])\s+', '\1␞', 'g'), '␞|\n+') AS l FROM documents))
WHERE length(trim(regexp_replace(x, '\s+', ' ', 'g'))) BETWEEN 24 AND 500 AND (source = 'src1' OR regexp_matches(trim(regexp_replace(x, '\s+', ' ', 'g')), '(?i)\b(achieved|achieves|outperform|outperformed|improve|improved|increase|increased|decrease|decreased|significant|accuracy|f1|auc|precision|recall|limitation|limited|conclude|conclusion|result|results)\b|[%=><±]'))""")
def flt21_claim_sentences(spark, sf_dir):
    """Sentences that may be claims: of 24 to 500 characters, in a section of results or with a signal of one."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("source") == "src1").alias("r"), F.posexplode(text.claim_sentences(F.coalesce("text", F.lit("")))).alias("pos", "s"))
    return rows.where(F.length("s").between(24, 500) & (F.col("r") | F.col("s").rlike(RESULT_SIGNAL))).select("doc_id", F.col("pos").cast("long").alias("pos"))


@BOOK.add("""SELECT vec_id, label FROM (SELECT vec_id, label, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), (SELECT list_transform(embedding, lambda x: x::DOUBLE) FROM embeddings WHERE vec_id = 11)) AS s FROM embeddings) ORDER BY round(s, 2) DESC, label DESC, vec_id LIMIT 30""")
def srt6_vector_order(spark, sf_dir):
    """By score, then the newer, then the chunk's place; the first 30."""
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.where("vec_id = 11").select(F.col("embedding").alias("q"))
    scored = vectors.crossJoin(F.broadcast(query)).select("vec_id", "label", numbers.cosine(F.col("embedding"), F.col("q")).alias("s"))
    return scored.orderBy(F.desc(F.round("s", 2)), F.desc("label"), "vec_id").limit(30).select("vec_id", "label")
