"""Markdown and page lines as sections, images and tables, and what they are: windows over the lines of a document."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import evidence
from docloom.operators.charts import panel_labels
from docloom.operators.library import CHART_WORDS, cascade
from docloom.operators.retrieval import VERBS
from docloom.plans import derived
from docloom.plans.book import Book, table
from docloom.plans.derived import ASSETS, cte

BOOK = Book()
#: Words that speak for a chart and for a photograph.
CHART_SIGNS = ["figure", "fig.", "chart", "plot", "graph", "curve", "schematic", "diagram", "illustration", "图谱", "示意图", "曲线", "趋势", "关系"]
PHOTO_SIGNS = ["sem", "tem", "afm", "micrograph", "microscopy", "photo", "image of", "photograph", "显微", "照片", "sem图像"]
#: Image types with coordinates and without, sources and words that speak against coordinates.
COORDINATE_TYPES = ["2d_field_map", "bar", "bar_chart", "bar_or_line_with_errorbar", "biphasic_time_series", "coordinate_plot", "dual_axis_plot", "generic_coordinate_plot", "grouped_bar", "heatmap_matrix", "line", "line_chart", "line_plot", "multi_line_plot", "rheology_flow_curve", "rheology_step_time_sweep", "rheology_strain_sweep", "scatter", "scatter_plot", "spectrum_curve"]
OTHER_TYPES = ["flowchart", "material_image", "microscope_image", "microscopy_quant", "molecular_structure", "multi_panel_composite", "natural_image", "non_data_image", "page_or_figure", "photo", "schematic", "schematic_or_photo", "text_image"]
OTHER_SUB_TYPES = ["flowchart", "natural_image", "photo", "schematic", "text_image"]
OTHER_SOURCES = ["fallback_snapshot", "page_visual_snapshot"]
OTHER_WORDS = ["组合图", "复合", "示意", "流程", "结构", "照片", "显微", "无坐标", "molecular", "trajectory", "schematic", "photo", "microscopy", "micrograph"]
LABEL = r"(?i)^\s*((?:fig\.?|figure|table)\s*\d+)"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, s, section): the lines of each text with the heading they stand under."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\r?\n")).alias("line", "s"))
    heading = F.nullif(F.regexp_extract("s", r"^#{1,6}\s+(.+?)\s*$", 1), F.lit(""))
    return rows.withColumn("section", F.coalesce(F.last(heading, ignorenulls=True).over(_upto("doc_id")), F.lit("")))


def _upto(by: str):
    return Window.partitionBy(by).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)


def images(rows: DataFrame) -> DataFrame:
    """(doc_id, line, path, alt, section, caption, label, context) of the images in Markdown lines.

    The caption is the next line with a label, of the eight after it; the context are the three lines before and after.
    """
    own = Window.partitionBy("doc_id").orderBy("line")
    near = F.array_join(F.filter(F.collect_list("s").over(own.rowsBetween(-3, 3)), lambda s: ~s.rlike(r"^\s*$|!\[")), "\n")
    next_ = F.first(F.when(F.col("s").rlike(LABEL), F.trim("s")), ignorenulls=True).over(own.rowsBetween(1, 8))
    marked = rows.withColumns({"context": near, "caption": next_}).where(F.col("s").rlike(r"!\[[^\]]*\]\([^)]+\)"))
    return marked.select("doc_id", "line", F.regexp_extract("s", r"!\[([^\]]*)\]\(([^)\s]+)", 2).alias("path"), F.regexp_extract("s", r"!\[([^\]]*)\]", 1).alias("alt"), "section", F.coalesce("caption", F.lit("")).alias("caption"), F.regexp_extract(F.coalesce("caption", F.lit("")), LABEL, 1).alias("label"), "context")


def tables(rows: DataFrame) -> DataFrame:
    """(doc_id, first, n_rows, header, section, label): runs of table lines, without separators, with the last label of the eight lines before."""
    own = Window.partitionBy("doc_id").orderBy("line")
    label = F.last(F.when(F.col("s").rlike(r"(?i)^\s*table\s*\d+"), F.regexp_extract("s", LABEL, 1)), ignorenulls=True).over(own.rowsBetween(-8, -1))
    piped = rows.withColumn("label", label).where(F.col("s").rlike(r"^\s*\|"))
    run = F.col("line") - F.row_number().over(own)
    return piped.withColumn("run", run).groupBy("doc_id", "run").agg(
        F.min("line").alias("first"), F.count_if(~F.col("s").rlike(r"^\s*\|(\s*:?-{3,}:?\s*\|)+\s*$")).alias("n"), F.min_by("s", "line").alias("header"), F.min_by("section", "line").alias("section"), F.min_by("label", "line").alias("label")
    ).select("doc_id", "first", (F.col("n") - 1).alias("n_rows"), "header", "section", F.coalesce("label", F.lit("")).alias("label"))


def image_assets(found: DataFrame) -> DataFrame:
    """(doc_id, path, evidence_type, chart_type): each image of a document once, as chart or figure by the words around it."""
    first = found.groupBy("doc_id", "path").agg(F.min_by(F.struct("caption", "alt", "context", "label"), "line").alias("f"))
    said = F.concat_ws(" ", "f.caption", "f.alt", "f.context")
    count = lambda words: reduce(lambda a, b: a + b, (F.contains(F.lower(said), F.lit(w)).cast("int") for w in words))
    chart, photo = count(CHART_SIGNS), count(PHOTO_SIGNS)
    kind = F.when(chart > photo, "chart").when(photo > chart, "figure").when(F.col("f.label") != "", "chart").otherwise("figure")
    return first.select("doc_id", "path", kind.alias("evidence_type"), cascade(said, CHART_WORDS, "unknown").alias("chart_type"))


def caption_bindings(figures: DataFrame, bodies: DataFrame) -> DataFrame:
    """(fig, label, panels, refs, near): what a document's text says of each of its figures.

    ``figures``: fig, doc_id, label, caption; ``bodies``: doc_id, text. Mentions are counted without white space, ``Figure`` as ``Fig``.
    """
    rows = figures.join(bodies, "doc_id", "left")
    flat = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)\s+", ""), r"figure|fig\.", "fig")
    base = F.regexp_replace(F.regexp_replace(F.lower("label"), r"\s+", ""), r"figure|fig\.", "fig")
    refs = F.when(base != "", ((F.length(flat) - F.length(F.replace(flat, base, F.lit("")))) / F.length(base)).cast("long")).otherwise(F.lit(0).cast("long"))
    at = F.instr(F.lower(F.coalesce("text", F.lit(""))), F.lower("label"))
    start = F.greatest(F.lit(1), at - 200)
    near = F.when(at > 0, text.strip(F.substring(F.col("text"), start, F.least(F.length("text"), at + F.length("label") - 1 + 400) - start + 1))).otherwise("")
    return rows.select("fig", "label", F.array_join(panel_labels(F.col("caption")), "").alias("panels"), refs.alias("refs"), near.alias("near"))


def coordinate_asset(metadata: str = "metadata") -> Column:
    """Whether an asset (asset_type, file_path, metadata) is a picture from which coordinates can be read, in seven steps."""
    key = lambda k: F.lower(text.strip(F.coalesce(F.get_json_object(metadata, f"$.{k}"), F.lit(""))))
    source, truth = F.coalesce(F.get_json_object(metadata, "$.source"), F.lit("")), key("data_extraction_possible").isin("true", "1", "yes")
    other = reduce(lambda a, b: a | b, (key(k).isin(OTHER_TYPES) for k in ("image_type", "chart_type", "figure_type"))) | evidence.has_any(key("mineru_sub_type"), OTHER_SUB_TYPES)
    kind = text.coalesce_blank(key("coordinate_preview.image_type"), key("image_type"), key("chart_type"), key("figure_type"), key("mineru_sub_type"))
    said = F.concat_ws(" ", *(key(k) for k in ("figure_type", "caption", "agent_description", "context")))
    role = F.coalesce(F.get_json_object(metadata, "$.visual_role"), F.lit(""))
    return (
        F.when((F.coalesce("file_path", F.lit("")) == "") | (F.col("asset_type") != "figure"), False).when(source.isin(OTHER_SOURCES), False).when(other, False).when(source == "extracted_image", truth)
        .when(evidence.has_any(said, OTHER_WORDS), False).when(F.coalesce(kind.isin(COORDINATE_TYPES), F.lit(False)), True).when(evidence.evidence_type() != "chart", False).when(truth, True)
        .otherwise(source.isin("mineru_chart", "rendered_figure_region") & role.isin("chart", "chart_candidate"))
    )


def triples_by(chunks: DataFrame, extract: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    """Triples of each sentence by any extractor: a function from a sentence to a struct(subject, predicate, object), null for none."""
    rows = chunks.select(id_col, F.posexplode(F.split(text_col, r"[.;]\s*", -1)).alias("seq", "s"))
    return rows.select(id_col, "seq", extract(F.col("s")).alias("t")).where("t is not null").select(id_col, "seq", "t.*")


# --- queries ---
_MD = """'# Intro' || chr(10) || 'Some text of ' || source || '.' || chr(10) || chr(10) || '![alt a](images/a' || doc_id || '.png)' || chr(10) || 'Figure 1. Growth curve' || chr(10) || chr(10) || '## Results' || chr(10) || 'Table 1 Sizes' || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10) || 'End ![](x.png) again ' || lang || chr(10) || '![sem photo](images/a' || doc_id || '.png)' || chr(10) || '|only|'"""


def _markdown(spark, sf_dir) -> DataFrame:
    return lines(table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_MD} AS text"))


@BOOK.add("""SELECT doc_id, unnest([3, 12, 13]) AS line, unnest(['images/a' || doc_id || '.png', 'x.png', 'images/a' || doc_id || '.png']) AS path, unnest(['alt a', '', 'sem photo']) AS alt, unnest(['Intro', 'Results', 'Results']) AS section, unnest(['Figure 1. Growth curve', '', '']) AS caption, unnest(['Figure 1', '', '']) AS label,
unnest(['# Intro' || chr(10) || 'Some text of ' || source || '.' || chr(10) || 'Figure 1. Growth curve' || chr(10) || '## Results', '| --- | --- |' || chr(10) || '| 1 | 2 |' || chr(10) || '|only|', '| 1 | 2 |' || chr(10) || '|only|']) AS context FROM documents""")
def doc13_markdown_images(spark, sf_dir):
    return images(_markdown(spark, sf_dir))


@BOOK.add("""SELECT doc_id, unnest([8, 14]) AS first, unnest([1, 0])::BIGINT AS n_rows, unnest(['| a | b |', '|only|']) AS header, 'Results' AS section, unnest(['Table 1', 'Table 1']) AS label FROM documents""")
def doc13_markdown_tables(spark, sf_dir):
    return tables(_markdown(spark, sf_dir))


@BOOK.add("""SELECT doc_id, unnest(['images/a' || doc_id || '.png', 'x.png']) AS path, unnest(['chart', 'figure']) AS evidence_type, unnest(['line', 'unknown']) AS chart_type FROM documents""")
def doc14_image_assets(spark, sf_dir):
    return image_assets(images(_markdown(spark, sf_dir)))


@BOOK.add(f"""WITH {cte('a', ASSETS)}, b AS (SELECT doc_id, 'See Figure 3 and fig. 3, then Figure  12 of ' || source AS t FROM documents), f AS (SELECT id AS fig, doc_id, CASE WHEN id % 2 = 0 THEN 'Figure 3' ELSE 'Figure 12' END AS label, id % 3 = 0 AS p FROM a)
SELECT fig, label, CASE WHEN p THEN 'AB' ELSE '' END AS panels, CASE WHEN label = 'Figure 3' THEN 2 ELSE 1 END::BIGINT AS refs, CASE WHEN label = 'Figure 3' THEN t ELSE '' END AS near FROM f JOIN b USING (doc_id)""")
def doc16_caption_bindings(spark, sf_dir):
    figures = derived.rows(spark, sf_dir, ASSETS).select(F.col("id").alias("fig"), "doc_id", F.when(F.col("id") % 2 == 0, "Figure 3").otherwise("Figure 12").alias("label"), F.when(F.col("id") % 3 == 0, "Cells (a, B)").otherwise("Cells").alias("caption"))
    bodies = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("See Figure 3 and fig. 3, then Figure  12 of "), "source").alias("text"))
    return caption_bindings(figures, bodies)


@BOOK.add(f"""WITH {cte('a', ASSETS)}, k AS (SELECT *, coalesce(json_extract_string(metadata, '$.source'), '') AS src, coalesce(json_extract_string(metadata, '$.visual_role'), '') AS role, lower(trim(coalesce(nullif(json_extract_string(metadata, '$.evidence_type'), ''), json_extract_string(metadata, '$.evidenceType'), ''))) AS st FROM a)
SELECT id, coalesce(file_path, '') <> '' AND asset_type = 'figure' AND src NOT IN ('fallback_snapshot','page_visual_snapshot') AND coalesce(lower(json_extract_string(metadata, '$.chart_type')), '') <> 'schematic' AND CASE WHEN src = 'extracted_image' THEN json_extract_string(metadata, '$.data_extraction_possible') = 'true' WHEN json_extract_string(metadata, '$.image_type') = 'line_plot' THEN true
ELSE src = 'rendered_figure_region' AND role = 'chart' END AS coordinates FROM k""")
def flt18_coordinate_assets(spark, sf_dir):
    return derived.rows(spark, sf_dir, ASSETS).select("id", coordinate_asset().alias("coordinates"))


@BOOK.add("""SELECT c_custkey, 1 AS seq, replace(c_name, '#', '_') AS subject, 'uses' AS predicate, 'Segment' || substr(c_mktsegment, 1, 3) AS object FROM customer""")
def udf2_injected_extractor(spark, sf_dir):
    """Triples by an extractor that is handed in, here the pattern of the built-in one."""
    pattern = rf"^\s*([A-Z][A-Za-z0-9_-]{{1,80}})\s+({VERBS})\s+([A-Za-z0-9_-]{{1,80}})\s*$"
    extract = lambda s: F.when(s.rlike(pattern), F.struct(*(F.regexp_extract(s, pattern, i).alias(n) for i, n in enumerate(("subject", "predicate", "object"), 1))))
    said = F.concat(F.lit("Intro words here. "), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit(" uses Segment"), F.substring("c_mktsegment", 1, 3), F.lit("; no triple"))
    return triples_by(table(spark, sf_dir, "customer").select("c_custkey", said.alias("t")), extract, "c_custkey", "t")


@BOOK.add("""WITH e AS (SELECT conv_id AS doc_id, turn AS page, CASE WHEN turn % 3 = 0 THEN 'ocr' ELSE 'pymupdf' END AS method, turn % 4 = 0 AS bad, CASE WHEN turn % 4 = 0 THEN 'bad_text_layer' END AS warning FROM conversations)
SELECT doc_id, count(DISTINCT page) AS pages_total, count(DISTINCT page) FILTER (method = 'ocr') AS pages_ocr, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (bad), '') AS bad_pages, count(*) FILTER (method = 'ocr') AS ocr_elements,
array_to_string(list_filter([CASE WHEN bool_or(warning IS NOT NULL) THEN 'bad_text_layer' END, CASE WHEN count(DISTINCT page) FILTER (method = 'ocr') * 2 >= count(DISTINCT page) THEN 'many_pages_required_ocr' END, CASE WHEN count(DISTINCT page) FILTER (bad) * 2 >= count(DISTINCT page) THEN 'many_pages_have_bad_text_layer' END], lambda w: w IS NOT NULL), '|') AS warnings FROM e GROUP BY doc_id""")
def agg13_page_quality(spark, sf_dir):
    """Quality of a document's pages: how many were recognized, which have a bad text layer, the methods as a histogram, and what to warn of."""
    e = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.when(F.col("turn") % 3 == 0, "ocr").otherwise("pymupdf").alias("method"), (F.col("turn") % 4 == 0).alias("bad"))
    pages = e.groupBy("doc_id", "page").agg(F.bool_or(F.col("method") == "ocr").alias("ocr"), F.bool_or("bad").alias("bad"))
    methods = e.groupBy("doc_id", "method").count().groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("method", "count"))).alias("methods"))
    per = pages.groupBy("doc_id").agg(F.count("*").alias("pages_total"), F.count_if("ocr").alias("pages_ocr"), F.array_sort(F.collect_set(F.when(F.col("bad"), F.col("page")))).alias("b"))
    many = lambda n, name: F.when(n * 2 >= F.col("pages_total"), name)
    found = F.array(F.when(F.size("b") > 0, "bad_text_layer"), many(F.col("pages_ocr"), "many_pages_required_ocr"), many(F.size("b"), "many_pages_have_bad_text_layer"))
    return per.join(methods, "doc_id").select("doc_id", "pages_total", "pages_ocr", F.array_join(F.col("b").cast("array<string>"), ",").alias("bad_pages"), F.coalesce(F.try_element_at("methods", F.lit("ocr")), F.lit(0).cast("long")).alias("ocr_elements"), F.array_join(F.filter(found, lambda w: w.isNotNull()), "|").alias("warnings"))
