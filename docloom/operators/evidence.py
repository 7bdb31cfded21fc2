"""What an extracted item rests on: labels of evidence, routing of results, and the rules by which results are kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.plans import derived
from docloom.plans.book import Book, table
from docloom.plans.derived import ASSETS, EVIDENCE, ITEMS, TABLES, cte

BOOK = Book()
#: Kinds of evidence, and phrases that say a result is none.
EVIDENCE_TYPES = ["text", "table", "figure", "chart", "equation", "page_region", "unknown"]
NEGATIVE = ["没有任何", "没有可", "不包含可", "无法提取", "不能提取", "不可读取", "无法读取", "没有坐标轴", "没有可见比例尺", "没有可直接读取", "不存在可", "无可提取"]
NEGATIVE_AGENT = [*NEGATIVE, "not contain", "no extractable", "no visible"]
#: Words in a description that show something was seen.
POSITIVE_VISUAL = ["显示", "可见", "标注", "位于", "呈现", "结构", "数值", "趋势", "柱", "曲线", "OmpF", "AI-2"]
#: Kinds of images without data points.
NON_DATA = ["non_data_image", "schematic", "schematic_or_photo", "microscopy_quant", "multi_panel_composite"]
#: Labels of a document's progress.
READY, PARSED, WAITING, RUNNING, FAILED = "就绪（可提取）", "正文已解析", "等待解析", "解析中", "解析失败"
#: Extraction modes by a part of the stated mode, then by chart type.
MODE_PARTS = [("coordinate_extraction", "chart_coordinate_extraction"), ("bar_chart", "chart_bar_extraction"), ("heatmap", "chart_heatmap_extraction"), ("table_image", "chart_table_extraction"), ("visual_descriptive", "visual_descriptive"), ("non_data", "visual_descriptive")]
MODE_TYPES = {
    "chart_coordinate_extraction": ["line_plot", "biphasic_time_series", "multi_line_plot", "rheology_flow_curve", "rheology_strain_sweep", "rheology_step_time_sweep", "scatter_plot", "spectrum_curve", "bar_or_line_with_errorbar", "generic_coordinate_plot", "dual_axis_plot"],
    "chart_bar_extraction": ["bar_chart", "grouped_bar"],
    "chart_heatmap_extraction": ["heatmap", "heatmap_matrix", "2d_field_map"],
    "chart_table_extraction": ["table_image"],
    "visual_descriptive": ["non_data_image", "microscopy_quant", "schematic", "schematic_or_photo"],
}
#: Labels that name a table.
TABLE_LABEL = r"(?i)^(?:supplementary\s+)?table\s+(?:\d+[a-z]?|[ivxlcdm]+)\b|^表\s*\d+[a-z]?\b"
#: Explicit and time-bound words of a question that ask for the web.
WEB_WORDS = ["搜索", "上网查", "网上", "互联网", "百度", "谷歌", "search web", "search online", "google", "look up online"]
TIME_WORDS = ["最新", "今天", "现在", "当前", "最近", "刚刚", "2026", "今年", "本月", "本周", "latest", "current", "recent", "today", "now", "this year"]


def has_any(value: Column, markers: list[str], fold: bool = True) -> Column:
    hay = F.coalesce(F.lower(value) if fold else value, F.lit(""))
    return reduce(lambda a, b: a | b, (F.contains(hay, F.lit(m.lower() if fold else m)) for m in markers))


def blank(value: Column) -> Column:
    return text.strip(F.coalesce(value, F.lit(""))) == ""


def _key(metadata: str, *names: str) -> Column:
    return text.coalesce_blank(*(F.get_json_object(metadata, f"$.{n}") for n in names))


def evidence_type(source_type: Column | None = None, metadata: str = "metadata", asset_type: str = "asset_type", file_path: str = "file_path", asset: Column | None = None) -> Column:
    """Kind of evidence: as the metadata state it, else by the item's source, else by the asset's type, source and role."""
    stated = F.lower(text.strip(_key(metadata, "evidence_type", "evidenceType")))
    source, role = F.coalesce(_key(metadata, "source"), F.lit("")), F.coalesce(_key(metadata, "visual_role"), F.lit(""))
    item = F.lit(None).cast("string") if source_type is None else source_type
    has_file = F.coalesce(file_path, F.lit("")) != ""
    kind = F.coalesce(asset_type, F.lit(""))
    return (
        F.when(stated.isin(EVIDENCE_TYPES), stated).when(stated.isin("image", "visual", "picture"), "figure").when(stated.isin("text_region", "ocr_text"), "text")
        .when(item.isin("text", "table", "figure"), item)
        .when(F.lit(False) if asset is None else ~asset, "unknown")
        .when(kind.isin("table", "equation"), kind)
        .when((kind == "page_snapshot") | source.isin("page_visual_snapshot", "fallback_snapshot"), "page_region")
        .when(source == "extracted_image", "figure")
        .when((source == "rendered_figure_region") & role.isin("chart", "chart_candidate"), "chart")
        .when((source == "rendered_figure_region") & role.isin("figure", "figure_candidate", "image_object") & has_file, "figure")
        .when(source == "rendered_figure_region", "page_region")
        .when((kind == "figure") & has_file, "figure").otherwise("unknown")
    )


def image_url(asset_id: str = "id", file_path: str = "file_path", mime_type: str = "mime_type") -> Column:
    """Address of an asset with a file that is, as far as is known, an image."""
    mime = F.lower(F.coalesce(mime_type, F.lit("")))
    return F.when((F.coalesce(file_path, F.lit("")) != "") & ((mime == "") | mime.startswith("image/")), F.concat(F.lit("/papers/assets/"), F.col(asset_id).cast("string")))


def bounding_box(metadata: str = "metadata") -> Column:
    """Four numbers or null; numbers may be given as text."""
    numbers = F.transform(F.from_json(F.get_json_object(metadata, "$.bbox"), "array<string>"), lambda x: x.try_cast("double"))
    return F.when((F.size(numbers) == 4) & ~F.exists(numbers, lambda x: x.isNull()), numbers)


def progress_label(status: str, visuals: str) -> Column:
    """Label of a document's state; ``visuals`` counts its tables, figures and page pictures."""
    s = F.col(status)
    done = F.when(F.col(visuals) > 0, READY).otherwise(PARSED)
    return F.when(s.isin("done", "completed", "parsed"), done).when(s.isin("pending", "uploaded"), WAITING).when(s.isin("processing", "parsing", "extracting"), RUNNING).when(s == "failed", FAILED).otherwise(s)


def is_markdown_table(content: str) -> Column:
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "[\r\n]+"), text.strip), lambda s: s != "")
    return (F.size(lines) >= 2) & F.coalesce(F.get(lines, F.lit(0)).startswith("|") & F.get(lines, F.lit(1)).startswith("|") & F.contains(F.get(lines, F.lit(1)), F.lit("---")), F.lit(False))


def table_status(label: str = "label", content: str = "content") -> tuple[Column, Column]:
    """(parse status, source) of an extracted table."""
    name = F.coalesce(label, F.lit(""))
    weak = name.startswith("Detected Table-like Block")
    status = F.when(F.contains(name, F.lit("Table Candidate")), "fallback").when(weak, "partial").when(is_markdown_table(content), "success").when(name.rlike(TABLE_LABEL), "fallback").otherwise("partial")
    return status, F.when(status == "success", "pdfplumber").when(status == "fallback", "fallback_candidate").when(weak, "weak_table_candidate").otherwise("text_candidate")


def field_name(value: str | Column, other: str = "unknown") -> Column:
    """Words of a name joined by underscores, 80 characters at most."""
    own = text.strip(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")))
    return text.coalesce_blank(F.substring(F.regexp_replace(own, r"(?U)\s+", "_"), 1, 80), F.lit(other))


def routed(items: DataFrame, assets: DataFrame) -> DataFrame:
    """``items`` with evidence_type, bucket (figure, table, text, not_found), image_url and page, by the asset each rests on."""
    own = assets.select(F.col("id").alias("a_id"), "asset_type", "file_path", "mime_type", "metadata", F.col("page").alias("a_page"), "caption")
    rows = items.join(own, items["asset_id"] == own["a_id"], "left")
    kind = evidence_type(F.col("source_type"), asset=F.col("a_id").isNotNull())
    rows = rows.withColumn("evidence_type", kind)
    empty = (F.coalesce("value_text", F.lit("")) == "") & (F.coalesce("data_points", F.lit("")) == "")
    visual = F.col("evidence_type").isin("figure", "chart", "page_region") & (F.coalesce("file_path", F.lit("")) != "")
    bucket = F.when(empty, "not_found").when(visual, "figure").when(F.col("evidence_type") == "table", "table").otherwise("text")
    return rows.withColumns({"bucket": bucket, "image_url": image_url("a_id")})


def evidence_text(excerpt: str = "excerpt", context: str = "context", notes: str = "notes") -> Column:
    return F.coalesce(text.coalesce_blank(F.col(excerpt), F.col(context), F.col(notes)), F.lit(""))


def hidden(mode: Column, confidence: Column, visual: Column, content: Column, evidence: Column, notes: Column) -> Column:
    """Whether a result is left out: unsure ones, visual ones that say there is nothing, text without content or evidence."""
    bad = F.when(visual, has_any(content, NEGATIVE) | has_any(notes, NEGATIVE)).otherwise(blank(content) | blank(evidence) | has_any(content, NEGATIVE))
    return F.when(F.coalesce(mode == "not_found", F.lit(False)), F.lit(False)).when(F.coalesce(confidence < 0.5, F.lit(False)), F.lit(True)).otherwise(bad)


def valid_text(value: Column, evidence: Column) -> Column:
    return ~blank(value) & ~has_any(value, NEGATIVE_AGENT) & ~blank(evidence) & ~has_any(evidence, NEGATIVE_AGENT)


def valid_visual(success: Column, content: Column, evidence: Column, notes: Column, has_data: Column) -> Column:
    failed = F.lower(F.coalesce(success.cast("string"), F.lit("true"))).isin("false", "0", "no")
    sound = valid_text(content, evidence) & ~has_any(notes, NEGATIVE_AGENT)
    return ~failed & sound & (has_data | has_any(content, POSITIVE_VISUAL, fold=False))


def extraction_mode(mode: Column, chart_type: Column) -> Column:
    out = F.when(F.lit(False), "")
    for part, name in MODE_PARTS:
        out = out.when(F.contains(F.coalesce(mode, F.lit("")), F.lit(part)), name)
    for name, kinds in MODE_TYPES.items():
        out = out.when(chart_type.isin(kinds), name)
    return out.otherwise("visual_analysis")


def region_class(text_density: Column, image_density: Column, line_like: Column, grid_like: Column, drawings: Column, caption: Column) -> Column:
    """Kind of a page region by its densities, drawings and caption."""
    chart_words = has_any(caption, ["chart", "plot", "axis", "axes", "curve", "graph", "trend", "time-series", "time series"])
    shapes = (line_like >= 2) | chart_words
    is_table = (grid_like >= 6) | F.coalesce(caption, F.lit("")).rlike(r"(?i)\btable\b|表\s*\d+")
    return (
        F.when((text_density > 0.35) & (image_density < 0.04) & ~shapes, "text").when(is_table, "table").when(shapes & ((image_density >= 0.005) | (drawings >= 3)), "chart")
        .when((image_density >= 0.01) | (drawings > 0), "figure").otherwise("page_region")
    )


def region_kept(kind: Column, text_density: Column, image_density: Column, shapes: Column) -> Column:
    crowded = (text_density > 0.35) & (image_density < 0.02) & ~shapes
    return (kind == "table") | (kind.isin("figure", "chart") & ~((image_density < 0.002) & ~shapes) & ~crowded)


def due_jobs(jobs: DataFrame, now: Column, status: str, next_run: str, attempts: str, most: int) -> DataFrame:
    """Jobs to run now: those never scheduled or due, that are pending or failed with attempts left."""
    ready = F.col(next_run).isNull() | (F.col(next_run) <= now)
    return jobs.where(ready & ((F.col(status) == "pending") | ((F.col(status) == "failed") & (F.col(attempts) < most))))


def wants_web(question: str, hits: DataFrame, score: str = "score") -> DataFrame:
    """One row: whether a question needs the web, given the scores of what the library has found."""
    low = question.lower()
    explicit, timely = any(w in low for w in WEB_WORDS), any(w in low for w in TIME_WORDS)
    n, best = F.count("*"), F.coalesce(F.max(score), F.lit(0.0))
    return hits.agg(n.alias("hits"), ((n < 1) | (best < 0.3) | F.lit(explicit) | (F.lit(timely) & (n < 3))).alias("search_web"))


_TYPE_SQL = """CASE WHEN st IN ('text','table','figure','chart','equation','page_region','unknown') THEN st WHEN st IN ('image','visual','picture') THEN 'figure' WHEN st IN ('text_region','ocr_text') THEN 'text'
WHEN item IN ('text','table','figure') THEN item WHEN NOT found THEN 'unknown' WHEN asset_type IN ('table','equation') THEN asset_type WHEN asset_type = 'page_snapshot' OR src IN ('page_visual_snapshot','fallback_snapshot') THEN 'page_region'
WHEN src = 'extracted_image' THEN 'figure' WHEN src = 'rendered_figure_region' AND role IN ('chart','chart_candidate') THEN 'chart' WHEN src = 'rendered_figure_region' AND role IN ('figure','figure_candidate','image_object') AND coalesce(file_path, '') <> '' THEN 'figure'
WHEN src = 'rendered_figure_region' THEN 'page_region' WHEN asset_type = 'figure' AND coalesce(file_path, '') <> '' THEN 'figure' ELSE 'unknown' END"""
_KEYS_SQL = """lower(trim(coalesce(nullif(json_extract_string(metadata, '$.evidence_type'), ''), nullif(json_extract_string(metadata, '$.evidenceType'), '')))) AS st, coalesce(json_extract_string(metadata, '$.source'), '') AS src, coalesce(json_extract_string(metadata, '$.visual_role'), '') AS role"""


@BOOK.add(f"WITH {cte('a', ASSETS)}, k AS (SELECT *, {_KEYS_SQL}, NULL AS item, true AS found FROM a) SELECT id, {_TYPE_SQL} AS evidence_type FROM k")
def prj5_evidence_type(spark, sf_dir):
    return derived.rows(spark, sf_dir, ASSETS).select("id", evidence_type().alias("evidence_type"))


@BOOK.add(f"""WITH {cte('a', ASSETS)}, b AS (SELECT *, list_transform([0,1,2,3], lambda i: TRY_CAST(json_extract_string(metadata, '$.bbox[' || i || ']') AS DOUBLE)) AS n, json_array_length(metadata, '$.bbox') AS k FROM a)
SELECT id, CASE WHEN coalesce(file_path, '') <> '' AND (coalesce(mime_type, '') = '' OR starts_with(lower(mime_type), 'image/')) THEN '/papers/assets/' || id END AS image_url,
CASE WHEN k = 4 AND len(list_filter(n, lambda x: x IS NOT NULL)) = 4 THEN n[1] END AS x0, CASE WHEN k = 4 AND len(list_filter(n, lambda x: x IS NOT NULL)) = 4 THEN n[4] END AS y1 FROM b""")
def prj6_image_and_box(spark, sf_dir):
    box = bounding_box()
    return derived.rows(spark, sf_dir, ASSETS).select("id", image_url().alias("image_url"), box[0].alias("x0"), box[3].alias("y1"))


@BOOK.add(f"""WITH {cte('a', ASSETS)}, n AS (SELECT doc_id, count(*) FILTER (asset_type IN ('table','figure','page_snapshot')) AS visuals FROM a GROUP BY doc_id),
d AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'done' WHEN 1 THEN 'completed' WHEN 2 THEN 'parsed' WHEN 3 THEN 'pending' WHEN 4 THEN 'uploaded' WHEN 5 THEN 'parsing' WHEN 6 THEN 'failed' WHEN 7 THEN 'extracting' ELSE 'deleted' END AS status FROM documents)
SELECT d.doc_id, CASE WHEN status IN ('done','completed','parsed') THEN CASE WHEN coalesce(visuals, 0) > 0 THEN '{READY}' ELSE '{PARSED}' END WHEN status IN ('pending','uploaded') THEN '{WAITING}' WHEN status IN ('processing','parsing','extracting') THEN '{RUNNING}' WHEN status = 'failed' THEN '{FAILED}' ELSE status END AS progress
FROM d LEFT JOIN n ON d.doc_id = n.doc_id""")
def prj3_progress(spark, sf_dir):
    states = "CASE doc_id % 9 WHEN 0 THEN 'done' WHEN 1 THEN 'completed' WHEN 2 THEN 'parsed' WHEN 3 THEN 'pending' WHEN 4 THEN 'uploaded' WHEN 5 THEN 'parsing' WHEN 6 THEN 'failed' WHEN 7 THEN 'extracting' ELSE 'deleted' END AS status"
    counts = derived.rows(spark, sf_dir, ASSETS).groupBy("doc_id").agg(F.count_if(F.col("asset_type").isin("table", "figure", "page_snapshot")).alias("visuals"))
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", states).join(counts, "doc_id", "left").fillna(0, ["visuals"])
    return docs.select("doc_id", progress_label("status", "visuals").alias("progress"))


@BOOK.add(f"""WITH {cte('t', TABLES)}, l AS (SELECT *, list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls, coalesce(label, '') AS n FROM t),
s AS (SELECT id, n, CASE WHEN contains(n, 'Table Candidate') THEN 'fallback' WHEN starts_with(n, 'Detected Table-like Block') THEN 'partial' WHEN len(ls) >= 2 AND starts_with(ls[1], '|') AND starts_with(ls[2], '|') AND contains(ls[2], '---') THEN 'success'
WHEN regexp_matches(n, '(?i)^(supplementary +)?table +([0-9]+[a-z]?|[ivxlcdm]+)\\b') THEN 'fallback' ELSE 'partial' END AS parse_status FROM l)
SELECT id, parse_status, CASE parse_status WHEN 'success' THEN 'pdfplumber' WHEN 'fallback' THEN 'fallback_candidate' ELSE CASE WHEN starts_with(n, 'Detected Table-like Block') THEN 'weak_table_candidate' ELSE 'text_candidate' END END AS source FROM s""")
def prj4_table_status(spark, sf_dir):
    status, source = table_status()
    return derived.rows(spark, sf_dir, TABLES).select("id", status.alias("parse_status"), source.alias("source"))


@BOOK.add("""SELECT o_orderkey AS id, o_orderstatus AS status, o_orderstatus AS processing_status, coalesce(nullif(CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderpriority END, ''), CASE WHEN o_orderkey % 3 = 0 THEN 'broken' END) AS processing_error FROM orders""")
def prj1_document_view(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderpriority END AS fail_reason", "CASE WHEN o_orderkey % 3 = 0 THEN 'broken' END AS error_message")
    return rows.select("id", "status", F.col("status").alias("processing_status"), F.coalesce(F.nullif("fail_reason", F.lit("")), "error_message").alias("processing_error"))


_ROUTED_SQL = f"""WITH {cte('i', ITEMS)}, {cte('a', ASSETS)}, k AS (SELECT i.*, a.id IS NOT NULL AS found, asset_type, file_path, mime_type, a.page AS a_page, a.id AS a_id, i.source_type AS item, {_KEYS_SQL} FROM i LEFT JOIN a ON i.asset_id = a.id),
t AS (SELECT *, {_TYPE_SQL} AS evidence_type FROM k), r AS (SELECT *, CASE WHEN coalesce(value_text, '') = '' AND coalesce(data_points, '') = '' THEN 'not_found' WHEN evidence_type IN ('figure','chart','page_region') AND coalesce(file_path, '') <> '' THEN 'figure' WHEN evidence_type = 'table' THEN 'table' ELSE 'text' END AS bucket FROM t)"""


@BOOK.add(f"{_ROUTED_SQL} SELECT id, job_id, evidence_type, bucket FROM r")
def prj11_structured_routing(spark, sf_dir):
    """Each extracted item goes to figures, tables, text or what was not found, by its evidence and whether it has a value."""
    return routed(derived.rows(spark, sf_dir, ITEMS), derived.rows(spark, sf_dir, ASSETS)).select("id", "job_id", "evidence_type", "bucket")


@BOOK.add(f"""{_ROUTED_SQL} SELECT id, coalesce(nullif(excerpt, ''), nullif(context, ''), nullif(notes, ''), '') AS evidence, evidence_type, a_page AS page,
CASE WHEN coalesce(file_path, '') <> '' AND (coalesce(mime_type, '') = '' OR starts_with(lower(mime_type), 'image/')) THEN '/papers/assets/' || a_id END AS image_url,
CASE WHEN found THEN 'asset' ELSE item END AS source_type, CASE WHEN verified THEN 'verified' END AS parse_status FROM r""")
def prj10_result_rows(spark, sf_dir):
    rows = routed(derived.rows(spark, sf_dir, ITEMS), derived.rows(spark, sf_dir, ASSETS))
    return rows.select("id", evidence_text().alias("evidence"), "evidence_type", F.col("a_page").alias("page"), "image_url", F.when(F.col("a_id").isNotNull(), "asset").otherwise(F.col("source_type")).alias("source_type"), F.when(F.col("verified"), "verified").alias("parse_status"))


@BOOK.add(f"""WITH {cte('i', ITEMS)}, {cte('e', EVIDENCE)}, f AS (SELECT item_id, arg_min(source_type, id) AS st, arg_min(source_id, id) AS source_id, arg_min(excerpt, id) AS excerpt FROM e WHERE source_type IN ('figure','table') AND coalesce(source_id, 0) <> 0 GROUP BY item_id)
SELECT i.id, CASE id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'conflict' WHEN 2 THEN 'partial' ELSE 'unsupported' END AS parse_status, CASE WHEN f.st IS NULL THEN i.source_type ELSE 'asset' END AS source_type, f.source_id, CASE WHEN f.st = 'figure' THEN f.excerpt END AS caption,
coalesce(CASE WHEN f.st = 'figure' THEN f.excerpt END, notes, '') AS evidence, data_points IS NOT NULL AS has_points FROM i LEFT JOIN f ON i.id = f.item_id""")
def prj12_legacy_rows(spark, sf_dir):
    """Items as rows of the older form: states renamed, the first figure or table among the evidence as the source."""
    status = F.element_at(F.array(*(F.lit(s) for s in ("sufficient", "conflicted", "insufficient", "unresolved"))), (F.col("id") % 4 + 1).cast("int"))
    names = F.create_map(*(F.lit(x) for x in ("sufficient", "success", "conflicted", "conflict", "insufficient", "partial")))
    found = derived.rows(spark, sf_dir, EVIDENCE).where(F.col("source_type").isin("figure", "table") & (F.coalesce("source_id", F.lit(0)) != 0))
    first = found.groupBy("item_id").agg(F.min_by(F.struct("source_type", "source_id", "excerpt"), "id").alias("e")).select("item_id", F.col("e.source_type").alias("kind"), "e.source_id", F.when(F.col("e.source_type") == "figure", F.col("e.excerpt")).alias("caption"))
    rows = derived.rows(spark, sf_dir, ITEMS).drop("excerpt").join(first, F.col("id") == F.col("item_id"), "left")
    return rows.select("id", F.coalesce(F.try_element_at(names, status), F.lit("unsupported")).alias("parse_status"), F.when(F.col("kind").isNull(), F.col("source_type")).otherwise("asset").alias("source_type"), "source_id", "caption",
                       F.coalesce("caption", "notes", F.lit("")).alias("evidence"), F.col("data_points").isNotNull().alias("has_points"))


@BOOK.add(f"""WITH {cte('i', ITEMS)} SELECT id, coalesce(nullif(substr(regexp_replace(trim(indicator), '\\s+', '_', 'g'), 1, 80), ''), 'unknown') AS field,
CASE WHEN id % 7 = 0 THEN 'chart_coordinate_extraction' WHEN id % 7 = 1 THEN 'visual_descriptive' WHEN trim(image_type) = 'line_plot' THEN 'chart_coordinate_extraction' WHEN trim(image_type) = 'bar_chart' THEN 'chart_bar_extraction' WHEN trim(image_type) = 'table_image' THEN 'chart_table_extraction' ELSE 'visual_analysis' END AS mode FROM i""")
def prj14_field_and_mode(spark, sf_dir):
    stated = F.when(F.col("id") % 7 == 0, "agent_coordinate_extraction_v2").when(F.col("id") % 7 == 1, "non_data_fallback")
    return derived.rows(spark, sf_dir, ITEMS).select("id", field_name("indicator").alias("field"), extraction_mode(stated, F.trim("image_type")).alias("mode"))


@BOOK.add(f"""WITH {cte('i', ITEMS)}, n AS (SELECT *, len(list_filter(['no visible','没有可'], lambda m: contains(lower(coalesce(notes, '')), m))) > 0 AS bad FROM i)
SELECT id, bad AS negative, trim(coalesce(value_text, '')) <> '' AND trim(coalesce(excerpt, '')) <> '' AS valid_text, coalesce(value_text, '') <> '' AND coalesce(excerpt, '') <> '' AND NOT bad AND id % 13 <> 0 AND data_points IS NOT NULL AS valid_visual FROM n""")
def flt16_valid_text_and_visual(spark, sf_dir):
    rows = derived.rows(spark, sf_dir, ITEMS)
    visual = valid_visual(F.when(F.col("id") % 13 == 0, "False"), F.col("value_text"), F.col("excerpt"), F.col("notes"), F.col("data_points").isNotNull())
    return rows.select("id", has_any(F.col("notes"), NEGATIVE_AGENT).alias("negative"), valid_text(F.col("value_text"), F.col("excerpt")).alias("valid_text"), visual.alias("valid_visual"))


@BOOK.add("""SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'no visible') AS negative FROM documents""")
def flt15_markers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", has_any(F.col("text"), ["License", "no visible"]).alias("negative"))


@BOOK.add(f"""WITH {cte('i', ITEMS)} SELECT id FROM i WHERE lower(trim(image_type)) NOT IN ('non_data_image','schematic','schematic_or_photo','microscopy_quant','multi_panel_composite')""")
def flt17_data_items(spark, sf_dir):
    return derived.rows(spark, sf_dir, ITEMS).where(~F.lower(F.trim("image_type")).isin(NON_DATA)).select("id")


@BOOK.add(f"""WITH {cte('i', ITEMS)} SELECT id FROM i WHERE NOT CASE WHEN confidence < 0.5 THEN true WHEN source_type IN ('figure') OR figure_label IS NOT NULL THEN contains(coalesce(value_text, ''), '没有可') ELSE trim(coalesce(value_text, '')) = '' OR trim(coalesce(excerpt, '')) = '' END""")
def flt14_hidden_results(spark, sf_dir):
    visual = F.col("source_type").isin("asset", "figure", "chart") | (F.coalesce("figure_label", F.lit("")) != "")
    return derived.rows(spark, sf_dir, ITEMS).where(~hidden(F.lit("text"), F.col("confidence"), visual, F.col("value_text"), F.col("excerpt"), F.col("notes"))).select("id")


@BOOK.add("""WITH r AS (SELECT p_partkey AS id, (p_size % 10) / 20.0::DOUBLE AS td, (p_partkey % 12) / 200.0::DOUBLE AS idn, p_size % 4 AS ll, p_size % 8 AS gl, p_partkey % 5 AS dr, CASE p_size % 5 WHEN 0 THEN 'Growth curve of cells' WHEN 1 THEN 'Table 3 overview' ELSE 'Photo' END AS cap FROM part),
c AS (SELECT *, ll >= 2 OR cap = 'Growth curve of cells' AS shapes FROM r),
k AS (SELECT *, CASE WHEN td > 0.35::DOUBLE AND idn < 0.04::DOUBLE AND NOT shapes THEN 'text' WHEN gl >= 6 OR cap = 'Table 3 overview' THEN 'table' WHEN shapes AND (idn >= 0.005::DOUBLE OR dr >= 3) THEN 'chart' WHEN idn >= 0.01::DOUBLE OR dr > 0 THEN 'figure' ELSE 'page_region' END AS kind FROM c)
SELECT id, kind, kind = 'table' OR (kind IN ('figure','chart') AND NOT (idn < 0.002::DOUBLE AND NOT shapes) AND NOT (td > 0.35::DOUBLE AND idn < 0.02::DOUBLE AND NOT shapes)) AS kept FROM k""")
def flt20_region_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "(p_size % 10) / 20.0D AS td", "(p_partkey % 12) / 200.0D AS im", "p_size % 4 AS ll", "p_size % 8 AS gl", "p_partkey % 5 AS dr", "CASE p_size % 5 WHEN 0 THEN 'Growth curve of cells' WHEN 1 THEN 'Table 3 overview' ELSE 'Photo' END AS cap")
    rows = rows.withColumn("kind", region_class(*(F.col(c) for c in ("td", "im", "ll", "gl", "dr", "cap"))))
    shapes = (F.col("ll") >= 2) | F.contains(F.lower("cap"), F.lit("curve"))
    return rows.select("id", "kind", region_kept(F.col("kind"), F.col("td"), F.col("im"), shapes).alias("kept"))


@BOOK.add("""SELECT r.event_id FROM events r JOIN customer d ON r.user_id = d.c_custkey JOIN nation n ON d.c_nationkey = n.n_nationkey WHERE len(list_filter(['auto','click','germany','k": 7'], lambda t: r.event_type ILIKE '%' || t || '%' OR r.props ILIKE '%' || t || '%' OR d.c_name ILIKE '%' || t || '%' OR d.c_mktsegment ILIKE '%' || t || '%' OR n.n_name ILIKE '%' || t || '%')) > 0""")
def flt4_terms_over_joined_columns(spark, sf_dir):
    """Any of several terms in any of five columns of three joined tables."""
    terms, cols = ["auto", "click", "germany", 'k": 7'], ["event_type", "props", "c_name", "c_mktsegment", "n_name"]
    rows = table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.where(reduce(lambda a, b: a | b, (F.col(c).ilike(f"%{t}%") for t in terms for c in cols))).select("event_id")


@BOOK.add("""SELECT doc_id, 'flag' AS rule FROM documents WHERE NOT (lang = 'de') UNION ALL SELECT doc_id, 'status' FROM documents WHERE CASE WHEN source = 'src0' THEN 'deleted' ELSE 'done' END <> 'deleted'""")
def flt8_not_deleted(spark, sf_dir):
    """Both ways of saying that a document is deleted: by its flag, by its state."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "de").alias("is_deleted"), F.when(F.col("source") == "src0", "deleted").otherwise("done").alias("status"))
    return docs.where(~F.col("is_deleted")).select("doc_id", F.lit("flag").alias("rule")).unionByName(docs.where("status <> 'deleted'").select("doc_id", F.lit("status").alias("rule")))


@BOOK.add("""SELECT c_custkey FROM customer WHERE contains(lower(c_name), '#00000001') OR contains(lower(c_mktsegment), '#00000001')""")
def flt22_list_filter(spark, sf_dir):
    word = F.lit(" #00000001 ".strip().lower())
    return table(spark, sf_dir, "customer").where(F.contains(F.lower("c_name"), word) | F.contains(F.lower("c_mktsegment"), word)).select("c_custkey")


@BOOK.add("""WITH j AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'done' END AS status, event_id % 6 AS attempts, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS next_run FROM events)
SELECT event_id FROM j WHERE (next_run IS NULL OR next_run <= TIMESTAMP '2024-01-10') AND (status = 'pending' OR (status = 'failed' AND attempts < 5))""")
def flt11_due_jobs(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").selectExpr("event_id", "CASE event_type WHEN 'click' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'done' END AS status", "event_id % 6 AS attempts", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS next_run")
    return due_jobs(jobs, F.lit("2024-01-10").cast("timestamp_ntz"), "status", "next_run", "attempts", 5).select("event_id")


@BOOK.add("""SELECT count(*) AS hits, count(*) < 1 OR coalesce(max(score), 0) < 0.3::DOUBLE OR count(*) < 3 AS search_web FROM (SELECT (n_chars % 10) / 40.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'apache'))""")
def flt23_wants_web(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("apache"))).select((F.col("n_chars") % 10 / F.lit(40.0)).alias("score"))
    return wants_web("What is the latest release?", hits)


@BOOK.add(f"""WITH {cte('a', ASSETS)} SELECT d.doc_id, coalesce(string_agg(a.id::VARCHAR, ',' ORDER BY a.id), '') AS assets, count(a.id) AS n FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id GROUP BY d.doc_id""")
def join13_documents_with_assets(spark, sf_dir):
    """The assets of each document in one pass."""
    assets = derived.rows(spark, sf_dir, ASSETS).select("doc_id", "id")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(assets, "doc_id", "left")
    return rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("assets"), F.count("id").alias("n"))


def evidence_chunks(evidence: DataFrame, chunks: DataFrame, most: int = 120, least: int = 20) -> DataFrame:
    """(evidence_id, chunk_id): the first chunk of the same document that holds the evidence's first characters or is held by them.

    White space is collapsed on both sides and ``least`` characters are needed. An equi join on the document with the
    containment as its residual; of several chunks that with the smallest page (nulls last), index and id.
    ``evidence``: evidence_id, document_id, text; ``chunks``: chunk_id, document_id, page, chunk_index, text.
    """
    wanted = evidence.select("evidence_id", "document_id", F.substring(text.collapse(F.coalesce("text", F.lit(""))), 1, most).alias("wanted")).where(F.length("wanted") >= least)
    own = chunks.select("chunk_id", "document_id", "page", "chunk_index", text.collapse(F.coalesce("text", F.lit(""))).alias("own")).where("own <> ''")
    hits = wanted.join(own, "document_id").where(F.contains("own", F.col("wanted")) | F.contains("wanted", F.col("own")))
    order = F.struct(F.col("page").isNull(), "page", "chunk_index", "chunk_id")
    return hits.groupBy("evidence_id").agg(F.min_by("chunk_id", order).alias("chunk_id"))


@BOOK.add(r"""WITH c AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS own FROM conversations),
e AS (SELECT id, conv_id, trim(substr(own, 3, 200)) AS t FROM c), w AS (SELECT id, conv_id, substr(t, 1, 120) AS wanted FROM e WHERE length(substr(t, 1, 120)) >= 20),
h AS (SELECT w.id AS evidence_id, c.id AS chunk_id, row_number() OVER (PARTITION BY w.id ORDER BY CASE WHEN c.turn % 2 = 0 THEN c.turn END ASC NULLS LAST, c.turn, c.id) AS r FROM w JOIN c USING (conv_id) WHERE c.own <> '' AND (contains(own, wanted) OR contains(wanted, own)))
SELECT evidence_id, chunk_id FROM h WHERE r = 1""")
def join14_evidence_chunk(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    evidence = rows.select(F.col("id").alias("evidence_id"), F.col("conv_id").alias("document_id"), F.substring(text.collapse(F.col("text")), 3, 200).alias("text"))
    chunks = rows.select(F.col("id").alias("chunk_id"), F.col("conv_id").alias("document_id"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("page"), F.col("turn").alias("chunk_index"), "text")
    return evidence_chunks(evidence, chunks)


def table_sources(items: DataFrame, tables: DataFrame) -> DataFrame:
    """(item_id, table_id): the first table of the item's document that holds 20 characters of its evidence or value, or names its metric."""
    head = lambda c: F.when(F.length(text.collapse(F.coalesce(c, F.lit("")))) >= 20, F.substring(text.collapse(F.col(c)), 1, 20))
    rows = items.join(tables, "document_id")
    held = F.coalesce(F.contains("content", head("evidence")), F.lit(False)) | F.coalesce(F.contains("content", head("value")), F.lit(False))
    named = (F.coalesce("metric", F.lit("")) != "") & F.contains(F.lower("content"), F.lower("metric"))
    return rows.where(held | F.coalesce(named, F.lit(False))).groupBy("item_id").agg(F.min("table_id").alias("table_id"))


@BOOK.add(r"""WITH t AS (SELECT conv_id * 1000 + turn AS table_id, conv_id, text FROM conversations WHERE role = 'assistant'), i AS (SELECT conv_id * 1000 + turn AS item_id, conv_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 20) AS ev, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n, split_part(text, ' ', 2) AS metric FROM conversations WHERE role = 'user')
SELECT item_id, min(table_id) AS table_id FROM i JOIN t USING (conv_id) WHERE (n >= 20 AND contains(t.text, ev)) OR (metric <> '' AND contains(lower(t.text), lower(metric))) GROUP BY item_id""")
def join15_table_source(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.col("conv_id").alias("document_id"), "role", "text")
    items = talk.where("role = 'user'").select(F.col("k").alias("item_id"), "document_id", F.col("text").alias("evidence"), F.lit(None).cast("string").alias("value"), F.get(F.split("text", " "), F.lit(1)).alias("metric"))
    return table_sources(items, talk.where("role = 'assistant'").select(F.col("k").alias("table_id"), "document_id", F.col("text").alias("content")))


def caption_assets(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """(ref_id, asset_id): the asset of the reference's document with its label, else the first whose caption holds it.

    ``refs``: ref_id, doc_id, label; ``assets``: id, doc_id, label, caption. Only assets of the same document count.
    """
    fold = lambda c: F.lower(text.strip(F.coalesce(c, F.lit(""))))
    rows = refs.select("ref_id", "doc_id", fold("label").alias("wanted")).where("wanted <> ''")
    # Labels and captions that a document has often meet once; the smallest id stands for all assets alike.
    asked = rows.select("doc_id", "wanted").distinct()
    own = assets.select("doc_id", F.col("id").alias("a"), fold("label").alias("l"), fold("caption").alias("c"))
    labelled = asked.join(own.groupBy("doc_id", F.col("l").alias("wanted")).agg(F.min("a").alias("a")), ["doc_id", "wanted"]).withColumn("hit", F.lit(0))
    captioned = asked.join(own.groupBy("doc_id", "c").agg(F.min("a").alias("a")), "doc_id").where(F.contains("c", F.col("wanted"))).withColumn("hit", F.lit(1))
    best = labelled.select("doc_id", "wanted", "hit", "a").unionByName(captioned.select("doc_id", "wanted", "hit", "a")).groupBy("doc_id", "wanted").agg(F.min(F.struct("hit", "a")).alias("b"))
    return rows.join(best, ["doc_id", "wanted"]).groupBy("ref_id").agg(F.min("b").alias("b")).select("ref_id", F.col("b.a").alias("asset_id"))


@BOOK.add(f"""WITH {cte('a', ASSETS)}, r AS (SELECT id AS ref_id, doc_id, CASE WHEN id % 3 = 0 THEN lower(label) WHEN id % 3 = 1 THEN split_part(caption, ' ', 3) ELSE ' ' END AS label FROM a),
h AS (SELECT ref_id, a.id, row_number() OVER (PARTITION BY ref_id ORDER BY lower(a.label) <> lower(r.label), a.id) AS k FROM r JOIN a USING (doc_id) WHERE trim(r.label) <> '' AND (lower(a.label) = lower(r.label) OR contains(lower(a.caption), lower(r.label)))) SELECT ref_id, id AS asset_id FROM h WHERE k = 1""")
def join16_caption_asset(spark, sf_dir):
    assets = derived.rows(spark, sf_dir, ASSETS)
    label = F.when(F.col("id") % 3 == 0, F.upper("label")).when(F.col("id") % 3 == 1, F.split("caption", " ")[2]).otherwise(" ")
    return caption_assets(assets.select(F.col("id").alias("ref_id"), "doc_id", label.alias("label")), assets)
