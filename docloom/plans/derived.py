"""Rows in the shape of a document library, derived from the tables by expressions that Spark and DuckDB read alike.

The tables have no assets, extracted items or evidence of their own. Each list below gives the columns of such rows as SQL
text; ``rows`` selects them with Spark and ``cte`` writes them into the SQL of a query, so that both start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.plans.book import table

ASSETS = ("part", [
    "p_partkey AS id", "p_partkey % 40 AS doc_id",
    "CASE p_partkey % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'figure' WHEN 2 THEN 'page_snapshot' WHEN 3 THEN 'equation' ELSE 'figure' END AS asset_type",
    "CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 7 = 0 THEN '' ELSE concat('img/', p_partkey, '.png') END AS file_path",
    "CASE p_size % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'IMAGE/JPEG' WHEN 2 THEN 'application/pdf' ELSE '' END AS mime_type",
    "CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_size % 9 END AS page", "concat('Figure ', p_size) AS label", "concat('Figure ', p_size, '. ', p_name, ' ', p_type) AS caption",
    """CASE p_size % 10 WHEN 0 THEN '{"evidence_type": " Image "}' WHEN 1 THEN '{"source": "rendered_figure_region", "visual_role": "chart"}' WHEN 2 THEN '{"source": "rendered_figure_region", "visual_role": "figure"}'
    WHEN 3 THEN '{"source": "extracted_image", "bbox": [1, 2.5, 3, 4], "data_extraction_possible": true}' WHEN 4 THEN '{"bbox": [1, "x", 3, 4], "source": "fallback_snapshot"}' WHEN 5 THEN '{"evidenceType": "CHART", "bbox": [5, 6, 7]}'
    WHEN 6 THEN '{"image_type": "line_plot", "bbox": ["7", 8, 9, 10]}' WHEN 7 THEN '{"chart_type": "Schematic"}' WHEN 8 THEN '{"evidence_type": "ocr_text"}' ELSE NULL END AS metadata""",
])
ITEMS = ("events", [
    "event_id AS id", "user_id AS job_id", "ts AS created_at", "event_id % 200 AS asset_id", "CAST(event_id % 100 AS DOUBLE) / 100 AS confidence",
    "CASE event_id % 6 WHEN 0 THEN 'Figure_Data' WHEN 1 THEN '' ELSE concat(event_type, '  rate ', event_id % 9) END AS indicator",
    "CASE WHEN value > 100 THEN 'figure' WHEN value > 60 THEN 'table' WHEN value > 30 THEN 'text' ELSE 'caption' END AS source_type",
    "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '' ELSE concat('value ', event_id % 13) END AS value_text",
    """CASE WHEN event_id % 4 = 0 THEN '[{"x": 1, "y": 2}]' END AS data_points""",
    "CASE event_id % 5 WHEN 0 THEN 'No visible axis in this image' WHEN 1 THEN NULL ELSE 'checked' END AS notes",
    "CASE WHEN event_id % 6 = 2 THEN concat('Figure ', event_id % 50) END AS figure_label",
    "CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 8 = 0 THEN NULL ELSE concat('excerpt ', event_id % 17) END AS excerpt", "concat('context ', event_id % 5) AS context",
    "event_id % 9 = 0 AS verified", "CASE event_id % 4 WHEN 0 THEN 'line_plot' WHEN 1 THEN ' Schematic ' WHEN 2 THEN 'bar_chart' ELSE 'table_image' END AS image_type",
])
EVIDENCE = ("events", [
    "event_id AS id", "event_id % 300 AS item_id", "CASE event_id % 4 WHEN 0 THEN 'text_chunk' WHEN 1 THEN 'figure' WHEN 2 THEN 'table' ELSE 'caption' END AS source_type",
    "CASE WHEN event_id % 10 = 1 THEN NULL ELSE event_id % 200 END AS source_id", "concat('quote ', event_id % 23) AS excerpt",
])
TABLES = ("part", [
    "p_partkey AS id",
    "CASE p_partkey % 6 WHEN 0 THEN concat('Table Candidate ', p_size) WHEN 1 THEN concat('Detected Table-like Block ', p_size) WHEN 2 THEN concat('Table ', p_size) WHEN 3 THEN 'Supplementary Table IV' WHEN 4 THEN 'Overview' ELSE NULL END AS label",
    "CASE p_size % 4 WHEN 0 THEN concat('| Name | Size |', chr(10), '| --- | --- |', chr(10), '| ', p_name, ' | ', p_size, ' |', chr(10), chr(10), '| ', p_type, ' |  |') WHEN 1 THEN concat(p_name, chr(10), p_type) WHEN 2 THEN '  ' ELSE NULL END AS content",
])


def rows(spark: SparkSession, sf_dir: str, what: tuple[str, list[str]]) -> DataFrame:
    return table(spark, sf_dir, what[0]).selectExpr(*what[1])


def cte(name: str, what: tuple[str, list[str]]) -> str:
    return f"{name} AS (SELECT {', '.join(what[1])} FROM {what[0]})"


POINTS = ("events", [
    "event_id AS id", "user_id % 40 AS fig", "CASE event_id % 4 WHEN 0 THEN 'OD600' WHEN 1 THEN 'yield %' WHEN 2 THEN 'mass' ELSE '' END AS series",
    "CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(event_id % 37 AS DOUBLE) END AS x", "CASE WHEN event_id % 23 = 0 THEN NULL ELSE value / 10 - 1 END AS y", "CASE WHEN event_id % 5 = 0 THEN value END AS y_right",
    "CASE event_id % 4 WHEN 0 THEN 'data_chart' WHEN 1 THEN 'microscopy' WHEN 2 THEN 'protein_assay' ELSE 'non_data_visual' END AS family", "CAST(event_id % 100 AS DOUBLE) / 100 AS confidence",
    "CASE WHEN event_id % 3 = 0 THEN 's' ELSE '' END AS x_unit", "CASE WHEN event_id % 6 = 1 THEN 'Rate' ELSE '' END AS x_label", "CASE WHEN event_id % 3 = 1 THEN 'Pa' ELSE '' END AS y_unit", "CASE WHEN event_id % 9 = 0 THEN 'Stress' ELSE '' END AS y_label",
    "CASE event_id % 5 WHEN 0 THEN 'pixel' WHEN 1 THEN 'linear' ELSE 'log10' END AS x_axis_type", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(2 AS DOUBLE) / 4 END AS pixel_size", "event_id % 250 AS object_count",
    "CASE WHEN event_id % 8 = 1 THEN 'dapi' ELSE '' END AS channel", "CASE WHEN event_id % 12 = 5 THEN 'cell' ELSE '' END AS object_class", "CASE WHEN event_id % 10 = 3 THEN '' ELSE concat('shows ', event_type) END AS description",
    "CASE WHEN event_id % 16 = 1 THEN value END AS diameter", "CASE WHEN event_id % 12 = 2 THEN value END AS band_intensity", "CASE WHEN event_id % 20 = 2 THEN value END AS molecular_weight", "CASE WHEN event_id % 28 = 2 THEN 'p53' ELSE '' END AS target_protein",
    "CASE WHEN event_id % 44 = 2 THEN 'GAPDH' ELSE '' END AS loading_control", "CASE WHEN event_id % 11 = 0 THEN '' ELSE 'seen' END AS qualitative",
])
