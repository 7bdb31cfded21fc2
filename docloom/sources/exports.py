"""Exports: rows as they are written to CSV, JSON lines, Markdown and long tables, and the writers for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.functions.numbers import number_text
from docloom.operators import evidence
from docloom.plans import derived
from docloom.plans.book import Book, table
from docloom.plans.derived import ASSETS, ITEMS, POINTS, cte

BOOK = Book()
#: Columns that all families of points share, and those of each family.
COMMON = ["fig", "family", "confidence"]
FAMILIES = {
    "data_chart": ["series", "x", "y", "x_unit", "y_unit", "x_label", "y_label", "x_axis_type"],
    "microscopy": ["channel", "object_class", "object_count", "diameter", "pixel_size"],
    "protein_assay": ["band_intensity", "molecular_weight", "target_protein", "loading_control"],
    "other": ["series", "qualitative", "description"],
}
SERIES = "struct<chart_type:string,panels:array<struct<panel:string,series:array<struct<name:string,points:array<struct<x:double,y:double,error:string>>>>>>>"


def shown(value: Column) -> Column:
    """Text of a value, nothing for null."""
    return F.coalesce(value.cast("string"), F.lit(""))


def iso(ts: Column) -> Column:
    """ISO form with microseconds where there are any; nothing for null."""
    return F.coalesce(F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", ""), F.lit(""))


def document_rows(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """The nine columns of a list of documents, with their tags joined; missing numbers are 0, missing times empty."""
    joined = tags.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tags"))
    rows = docs.join(joined, "id", "left")
    return rows.select("id", "title", "source_type", "status", F.coalesce("file_size", F.lit(0).cast("long")).alias("file_size"), F.coalesce("page_count", F.lit(0).cast("long")).alias("page_count"), iso(F.col("created_at")).alias("created_at"), iso(F.col("updated_at")).alias("updated_at"), F.coalesce("tags", F.lit("")).alias("tags"))


def result_rows(items: DataFrame, assets: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """The sixteen columns of extraction results with the assets they rest on; ``ids`` asks for some of them."""
    rows = items if ids is None else items.where(F.col("id").isin(ids))
    rows = evidence.routed(rows, assets)
    page = F.when(F.coalesce("a_page", F.lit(0)) != 0, F.col("a_page").cast("string")).otherwise("")
    return rows.select(
        "id", evidence.field_name("indicator").alias("field_name"), shown(F.col("value_text")).alias("content"), shown(F.col("excerpt")).alias("evidence"), "confidence", "evidence_type", "source_type", F.col("a_id").alias("source_id"),
        shown(F.col("figure_label")).alias("figure_id"), F.coalesce("caption", F.lit("")).alias("caption"), shown(F.col("image_url")).alias("image_url"), page.alias("page"), shown(F.col("notes")).alias("notes"),
        F.when(F.col("verified"), "verified").otherwise("").alias("parse_status"), F.trim("image_type").alias("extraction_mode"), iso(F.col("created_at")).alias("created_at"),
    )


def job_lines(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """One JSON line a job with its results in order of id and their number; jobs without results have none.

    A job's results are one value, as the format asks; the flat rows of ``result_rows`` have no such bound.
    """
    own = results.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("id", "field_name", "content", "confidence"))).alias("results"))
    rows = jobs.join(own, "job_id", "left").withColumn("results", F.coalesce("results", F.array().cast("array<struct<id:bigint,field_name:string,content:string,confidence:double>>")))
    return rows.select("job_id", F.to_json(F.struct(*jobs.columns, "results", F.size("results").alias("total_results")), {"ignoreNullFields": "false"}).alias("value"))


def report_sections(rows: DataFrame) -> DataFrame:
    """(id, value): the Markdown section of each result with where it stands; only what is known has a line."""
    line = lambda head, column: F.when(F.coalesce(F.col(column).cast("string"), F.lit("")) != "", F.concat(F.lit(head), F.col(column).cast("string")))
    parts = [
        F.concat(F.lit("## "), "field_name"), F.lit(""), F.concat(F.lit("**Content:** "), "content"), F.lit(""), F.concat(F.lit("**Evidence:** "), "evidence"), F.lit(""),
        F.concat(F.lit("- Type: `"), "evidence_type", F.lit("`")), F.when(F.col("page") != "", F.concat(F.lit("- Page: p."), "page")).otherwise("- Page not resolved"), line("- Text Chunk: #", "chunk_id"), line("- Asset: #", "source_id"), line("- Figure/Table ID: ", "figure_id"), F.lit(""),
        F.concat(F.lit("**Confidence:** "), F.format_string("%.2f", "confidence")), line("**Caption:** ", "caption"), line("**Image:** ", "image_url"), line("**Notes:** ", "notes"), F.lit(""), F.lit("---"),
    ]
    return rows.select("id", F.concat_ws("\n", *parts).alias("value"))


def long_points(results: DataFrame) -> DataFrame:
    """(job_id, figure, panel, chart_type, series, x, y, error) of the latest chart of each figure of a job.

    ``results``: id, job_id, figure_id, structured_data (JSON). Panels, series and points are taken apart one after the other.
    """
    latest = results.where((F.coalesce("figure_id", F.lit("")) != "") & F.from_json("structured_data", SERIES)["panels"].isNotNull()).groupBy("job_id", "figure_id").agg(F.max_by("structured_data", "id").alias("data"))
    rows = latest.select("job_id", F.col("figure_id").alias("figure"), F.from_json("data", SERIES).alias("c")).select("job_id", "figure", "c.chart_type", F.explode("c.panels").alias("p"))
    rows = rows.select("job_id", "figure", "chart_type", "p.panel", F.explode("p.series").alias("s")).select("job_id", "figure", "panel", "chart_type", F.col("s.name").alias("series"), F.explode("s.points").alias("q"))
    return rows.where("q.x is not null and q.y is not null").select("job_id", "figure", "panel", "chart_type", "series", "q.x", "q.y", F.coalesce("q.error", F.lit("")).alias("error"))


def semantic_field(label: Column, unit: Column, other: str) -> Column:
    """``Label (unit)``; the unit is left out where the label names it, and without a label it is ``other``."""
    name, own = text.collapse(F.coalesce(label, F.lit(""))), text.collapse(F.coalesce(unit, F.lit("")))
    full = F.when((own != "") & ~F.contains(F.lower(name), F.lower(own)), F.concat(name, F.lit(" ("), own, F.lit(")"))).otherwise(name)
    return F.when(name == "", other).otherwise(full)


def axis_headers(points: DataFrame, by: str, order: str) -> DataFrame:
    """(by, x_field, y_field): the headers of each coordinate file, from the first of its rows that has a label."""
    field = lambda a: F.min_by(semantic_field(F.col(f"{a}_label"), F.col(f"{a}_unit"), f"{a}_value"), F.when(F.trim(f"{a}_label") != "", F.col(order)))
    return points.groupBy(by).agg(F.coalesce(field("x"), F.lit("x_value")).alias("x_field"), F.coalesce(field("y"), F.lit("y_value")).alias("y_field"))


def write_coordinates(points: DataFrame, path: str, order: str = "id") -> None:
    """One coordinate file set whose x and y columns are named by what they show."""
    first = axis_headers(points.withColumn("_all", F.lit(0)), "_all", order).first()
    x, y = (first["x_field"], first["y_field"]) if first else ("x_value", "y_value")
    rows = points.select(F.col("series").alias("series_name"), number_text(F.col("x")).alias(x), "x_unit", number_text(F.col("y")).alias(y if y != x else f"{y} (y)"), "y_unit", number_text(F.col("confidence")).alias("confidence"))
    rows.write.option("header", True).csv(path)


def item_rows(items: DataFrame) -> DataFrame:
    """The columns of an item list: numbers in short form, yes and no, names of the axes; pictures without data are left out."""
    kept = items.where(~F.lower(F.trim(F.coalesce("image_type", F.lit("")))).isin(evidence.NON_DATA))
    return kept.select(
        "id", shown(F.col("indicator")).alias("indicator"), shown(F.col("figure_label")).alias("figure_label"), "image_type", shown(F.col("notes")).alias("review_status"), F.coalesce(number_text(F.col("confidence")), F.lit("")).alias("confidence"), shown(F.col("value_text")).alias("value_text"),
        F.coalesce(number_text(text.first_number(F.col("value_text"))), F.lit("")).alias("value_numeric"), "source_type", F.when(F.col("verified"), "yes").when(~F.col("verified"), "no").otherwise("").alias("verified"),
    )


def item_points(items: DataFrame) -> DataFrame:
    """The points below an item list, one row each."""
    kept = items.where(~F.lower(F.trim(F.coalesce("image_type", F.lit("")))).isin(evidence.NON_DATA))
    rows = kept.select("id", "indicator", shown(F.col("figure_label")).alias("figure_label"), F.posexplode(F.from_json("data_points", "array<struct<x:double,y:double,series:string,error_bar:string>>")).alias("pos", "p"))
    return rows.select("id", "pos", "indicator", "figure_label", shown(F.col("p.series")).alias("series"), number_text(F.col("p.x")).alias("x"), number_text(F.col("p.y")).alias("y"), shown(F.col("p.error_bar")).alias("error_bar"))


def family_rows(points: DataFrame, family: str) -> DataFrame:
    """The points of a family with the columns it is written with; families that are not known have those of other."""
    known = F.col("family").isin([f for f in FAMILIES if f != "other"])
    return points.where(~known if family == "other" else F.col("family") == family).select("id", *COMMON, *FAMILIES[family])


def stored_points(points: DataFrame) -> DataFrame:
    """Points as rows of results: the first name there is, and success from a confidence of .5 on."""
    name = text.coalesce_blank(F.col("target_protein"), F.col("object_class"), F.col("series"), F.lit("visual_evidence"))
    content = F.coalesce(text.coalesce_blank(F.col("qualitative"), F.col("description")), F.lit(""))
    return points.select("id", name.alias("field_name"), content.alias("content"), "confidence", F.lit("asset").alias("source_type"), F.when(F.col("confidence") >= 0.5, "success").otherwise("partial").alias("parse_status"), F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("caption"))


def combined_lines(lines: DataFrame) -> DataFrame:
    """Lines of one file made of many: the header of the first and the lines of all files with the same header.

    ``lines``: file, pos (0 for a header), line. Files come in the order of their names.
    """
    headers = lines.where("pos = 0").select("file", F.col("line").alias("header"))
    first = headers.agg(F.min_by("header", "file").alias("header"), F.min("file").alias("first"))
    rows = lines.join(headers.join(F.broadcast(first), "header"), "file")
    return rows.where("pos > 0 or file = first").select("file", "pos", "line")


# --- queries ---
_DOCS = ["doc_id AS id", "substr(text, 1, 60) AS title", "lang AS source_type", "CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'done' END AS status", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END AS file_size", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars % 40 END AS page_count",
         "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE TIMESTAMP '2024-03-01 10:20:30' END AS created_at", "TIMESTAMP '2024-03-02 01:02:03.5' AS updated_at"]


@BOOK.add(f"""WITH d AS (SELECT {', '.join(_DOCS)} FROM documents), t AS (SELECT doc_id AS id, unnest(CASE WHEN quality = 1 THEN ['good','read'] ELSE ['read'] END) AS tag FROM labels), j AS (SELECT id, string_agg(DISTINCT tag, ', ' ORDER BY tag) AS tags FROM t GROUP BY id)
SELECT d.id, title, source_type, status, coalesce(file_size, 0) AS file_size, coalesce(page_count, 0) AS page_count, CASE WHEN created_at IS NULL THEN '' ELSE '2024-03-01T10:20:30' END AS created_at, '2024-03-02T01:02:03.500000' AS updated_at, coalesce(tags, '') AS tags FROM d LEFT JOIN j ON d.id = j.id""")
def snk1_document_list(spark, sf_dir):
    tags = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.explode(F.when(F.col("quality") == 1, F.array(F.lit("good"), F.lit("read"))).otherwise(F.array(F.lit("read")))).alias("tag"))
    return document_rows(table(spark, sf_dir, "documents").selectExpr(*_DOCS), tags)


_RESULT_SQL = r"""SELECT id, coalesce(nullif(substr(regexp_replace(trim(indicator), '\s+', '_', 'g'), 1, 80), ''), 'unknown') AS field_name, coalesce(value_text, '') AS content, coalesce(excerpt, '') AS evidence, confidence, evidence_type, item AS source_type, a_id AS source_id, coalesce(figure_label, '') AS figure_id, coalesce(a_caption, '') AS caption,
CASE WHEN coalesce(file_path, '') <> '' AND (coalesce(mime_type, '') = '' OR starts_with(lower(mime_type), 'image/')) THEN '/papers/assets/' || a_id ELSE '' END AS image_url, CASE WHEN coalesce(a_page, 0) <> 0 THEN a_page::VARCHAR ELSE '' END AS page, coalesce(notes, '') AS notes, CASE WHEN verified THEN 'verified' ELSE '' END AS parse_status, trim(image_type) AS extraction_mode,
regexp_replace(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), '\.000000$', '') AS created_at"""
_ROUTED_SQL = evidence._ROUTED_SQL.replace("a.id AS a_id,", "a.id AS a_id, a.caption AS a_caption,")


@BOOK.add(f"{_ROUTED_SQL} {_RESULT_SQL} FROM r")
def snk2_result_rows(spark, sf_dir):
    return result_rows(derived.rows(spark, sf_dir, ITEMS), derived.rows(spark, sf_dir, ASSETS))


@BOOK.add(f"""{_ROUTED_SQL}, q AS ({_RESULT_SQL}, job_id FROM r) SELECT c_custkey AS job_id, c_name AS paper_title, c_mktsegment AS query, q.id, q.field_name, q.content, q.confidence, q.evidence_type, q.page, count(*) OVER (PARTITION BY job_id) AS total_results FROM q JOIN customer ON job_id = c_custkey""")
def snk3_jobs_with_results(spark, sf_dir):
    """Results of many jobs, flat, with the number of results of each job."""
    items = derived.rows(spark, sf_dir, ITEMS)
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("paper_title"), F.col("c_mktsegment").alias("query"))
    totals = items.groupBy("job_id").agg(F.count("*").alias("total_results"))
    rows = result_rows(items, derived.rows(spark, sf_dir, ASSETS)).join(items.select("id", "job_id"), "id").join(jobs, "job_id").join(totals, "job_id")
    return rows.select("job_id", "paper_title", "query", "id", "field_name", "content", "confidence", "evidence_type", "page", "total_results")


@BOOK.add(f"""{_ROUTED_SQL}, q AS ({_RESULT_SQL} FROM r) SELECT id, concat_ws(chr(10), '## ' || field_name, '', '**Content:** ' || content, '', '**Evidence:** ' || evidence, '', '- Type: `' || evidence_type || '`', CASE WHEN page <> '' THEN '- Page: p.' || page ELSE '- Page not resolved' END,
CASE WHEN source_id % 2 = 0 THEN '- Text Chunk: #' || (source_id * 3) END, '- Asset: #' || source_id, CASE WHEN figure_id <> '' THEN '- Figure/Table ID: ' || figure_id END, '', '**Confidence:** ' || printf('%.2f', confidence), CASE WHEN caption <> '' THEN '**Caption:** ' || caption END, CASE WHEN image_url <> '' THEN '**Image:** ' || image_url END, CASE WHEN notes <> '' THEN '**Notes:** ' || notes END, '', '---') AS value FROM q""")
def snk4_report_sections(spark, sf_dir):
    rows = result_rows(derived.rows(spark, sf_dir, ITEMS), derived.rows(spark, sf_dir, ASSETS))
    return report_sections(rows.withColumn("chunk_id", F.when(F.col("source_id") % 2 == 0, F.col("source_id") * 3)))


_CHART = """concat('{"chart_type": "line_plot", "panels": [{"panel": "A", "series": [{"name": "s', event_id % 3, '", "points": [{"x": ', event_id % 50, ', "y": ', event_id % 7, ', "error": "0.1"}, {"x": null, "y": 1}]}, {"name": "t", "points": [{"x": 1, "y": 2.5}]}]}]}')"""


@BOOK.add("""WITH r AS (SELECT event_id, user_id, 'Figure ' || event_id % 5 AS f FROM events WHERE event_id % 4 <> 3 AND event_id % 9 <> 0), l AS (SELECT user_id, f, max(event_id) AS e FROM r GROUP BY user_id, f)
SELECT user_id AS job_id, f AS figure, 'A' AS panel, 'line_plot' AS chart_type, 's' || e % 3 AS series, (e % 50)::DOUBLE AS x, (e % 7)::DOUBLE AS y, '0.1' AS error FROM l UNION ALL SELECT user_id, f, 'A', 'line_plot', 't', 1, 2.5, '' FROM l""")
def snk5_long_points(spark, sf_dir):
    """The latest chart of each figure (WIN-14), its panels, series and points one row each (ARR-4)."""
    data = F.when(F.col("event_id") % 9 == 0, "not json").otherwise(F.expr(_CHART))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.when(F.col("event_id") % 4 != 3, F.concat(F.lit("Figure "), (F.col("event_id") % 5).cast("string"))).alias("figure_id"), data.alias("structured_data"))
    return long_points(rows)


@BOOK.add(f"""WITH {cte('p', POINTS)}, x AS (SELECT fig, arg_min(x_label, id) AS l, arg_min(x_unit, id) AS u FROM p WHERE x_label <> '' GROUP BY fig), y AS (SELECT fig, arg_min(y_label, id) AS l, arg_min(y_unit, id) AS u FROM p WHERE y_label <> '' GROUP BY fig)
SELECT f.fig, CASE WHEN x.l IS NULL THEN 'x_value' WHEN x.u <> '' AND NOT contains(lower(x.l), lower(x.u)) THEN x.l || ' (' || x.u || ')' ELSE x.l END AS x_field, CASE WHEN y.l IS NULL THEN 'y_value' WHEN y.u <> '' AND NOT contains(lower(y.l), lower(y.u)) THEN y.l || ' (' || y.u || ')' ELSE y.l END AS y_field
FROM (SELECT DISTINCT fig FROM p) f LEFT JOIN x ON f.fig = x.fig LEFT JOIN y ON f.fig = y.fig""")
def snk6_axis_headers(spark, sf_dir):
    return axis_headers(derived.rows(spark, sf_dir, POINTS), "fig", "id")


@BOOK.add(f"""WITH {cte('i', ITEMS)} SELECT id, indicator, coalesce(figure_label, '') AS figure_label, image_type, coalesce(notes, '') AS review_status, CASE WHEN confidence = floor(confidence) THEN CAST(CAST(confidence AS BIGINT) AS VARCHAR) ELSE format('{{:.6g}}', confidence) END AS confidence, coalesce(value_text, '') AS value_text,
CASE WHEN coalesce(value_text, '') <> '' THEN split_part(value_text, ' ', 2) ELSE '' END AS value_numeric, source_type, CASE WHEN verified THEN 'yes' ELSE 'no' END AS verified FROM i WHERE trim(image_type) <> 'Schematic'""")
def snk7_item_rows(spark, sf_dir):
    return item_rows(derived.rows(spark, sf_dir, ITEMS))


@BOOK.add(f"""WITH {cte('i', ITEMS)} SELECT id, 0 AS pos, indicator, coalesce(figure_label, '') AS figure_label, '' AS series, '1' AS x, '2' AS y, '' AS error_bar FROM i WHERE data_points IS NOT NULL AND trim(image_type) <> 'Schematic'""")
def snk7_item_points(spark, sf_dir):
    return item_points(derived.rows(spark, sf_dir, ITEMS))


@BOOK.add("""SELECT p_partkey AS id, p_name AS entity, p_type AS property_name, CASE WHEN p_retailprice * 1.25 = floor(p_retailprice * 1.25) THEN CAST(CAST(p_retailprice * 1.25 AS BIGINT) AS VARCHAR) ELSE format('{:.6g}', p_retailprice * 1.25::DOUBLE) END AS value_numeric, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'Pa' END AS value_unit,
CASE p_size % 4 WHEN 0 THEN '0' WHEN 1 THEN '0.25' WHEN 2 THEN '0.5' ELSE '0.75' END AS confidence FROM part""")
def snk8_property_rows(spark, sf_dir):
    """Property records with numbers in short form (MATH-15)."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("entity"), F.col("p_type").alias("property_name"), number_text(F.col("p_retailprice") * 1.25).alias("value_numeric"), shown(F.when(F.col("p_size") % 2 != 0, "Pa")).alias("value_unit"), number_text(F.col("p_size") % 4 / F.lit(4.0)).alias("confidence"))


_WRITTEN = list(dict.fromkeys(c for columns in FAMILIES.values() for c in columns))
_OF = {c: [f for f, columns in FAMILIES.items() if c in columns] for c in _WRITTEN}


@BOOK.add(f"""WITH {cte('p', POINTS)}, k AS (SELECT *, CASE WHEN family IN ('data_chart', 'microscopy', 'protein_assay') THEN family ELSE 'other' END AS kind FROM p)
SELECT id, fig, family, confidence, {', '.join(f"CASE WHEN kind IN ({', '.join(map(repr, _OF[c]))}) THEN {c} END AS {c}" for c in _WRITTEN)} FROM k""")
def snk9_family_rows(spark, sf_dir):
    """Points of each family with its own columns, numbers included, in one table: columns of other families are null."""
    points = derived.rows(spark, sf_dir, POINTS)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (family_rows(points, name) for name in FAMILIES))


@BOOK.add(f"""WITH {cte('p', POINTS)} SELECT id, coalesce(nullif(target_protein, ''), nullif(object_class, ''), nullif(series, ''), 'visual_evidence') AS field_name, coalesce(nullif(qualitative, ''), nullif(description, ''), '') AS content, confidence, 'asset' AS source_type, CASE WHEN confidence >= 0.5 THEN 'success' ELSE 'partial' END AS parse_status, substr(description, 1, 200) AS caption FROM p""")
def snk10_stored_points(spark, sf_dir):
    return stored_points(derived.rows(spark, sf_dir, POINTS))


@BOOK.add("""WITH l AS (SELECT lpad(conv_id::VARCHAR, 8, '0') AS file, turn AS pos, CASE WHEN turn = 0 THEN role || conv_id % 3 ELSE text END AS line FROM conversations), h AS (SELECT file, line AS header FROM l WHERE pos = 0), f AS (SELECT arg_min(header, file) AS header, min(file) AS first FROM h)
SELECT l.file, l.pos, l.line FROM l JOIN h ON l.file = h.file JOIN f ON h.header = f.header WHERE pos > 0 OR l.file = first""")
def snk11_combined_lines(spark, sf_dir):
    line = F.when(F.col("turn") == 0, F.concat("role", (F.col("conv_id") % 3).cast("string"))).otherwise(F.col("text"))
    return combined_lines(table(spark, sf_dir, "conversations").select(F.lpad(F.col("conv_id").cast("string"), 8, "0").alias("file"), F.col("turn").alias("pos"), line.alias("line")))


@BOOK.add("""SELECT event_id, s.panel, s.series, s.x, s.y FROM (SELECT event_id, unnest([{'panel': 'A', 'series': 's' || event_id % 3, 'x': (event_id % 50)::DOUBLE, 'y': (event_id % 7)::DOUBLE}, {'panel': 'A', 'series': 't', 'x': 1::DOUBLE, 'y': 2.5::DOUBLE}]) AS s FROM events)""")
def arr4_flattened_panels(spark, sf_dir):
    """Panels, their series and their points, one row a point with two numbers."""
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json(F.expr(_CHART), SERIES).alias("c")).select("event_id", F.explode("c.panels").alias("p"))
    rows = rows.select("event_id", "p.panel", F.explode("p.series").alias("s")).select("event_id", "panel", F.col("s.name").alias("series"), F.explode("s.points").alias("q"))
    return rows.where("q.x is not null and q.y is not null").select("event_id", "panel", "series", "q.x", "q.y")
