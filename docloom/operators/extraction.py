"""Property values from many sources: normalize, validate, fuse; and checks of digitized chart points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import numbers, text
from docloom.plans.book import Book, table

BOOK = Book()
#: Order of sources and of states.
SOURCES = {"section": 0, "table": 1, "caption": 2, "figure": 3, "fusion": 4}
STATES = {"sufficient": 3, "conflicted": 2, "insufficient": 1, "unsupported": 0}


def _rank(column: str, order: dict[str, int], other: int) -> Column:
    known = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.col(column)), F.lit(other))


def normalize(candidates: DataFrame) -> DataFrame:
    """Trimmed values, canonical units and the first number of each value."""
    return candidates.withColumns({"value": text.strip(F.col("value")), "unit": text.unit(F.col("unit")), "normalized_value": text.first_number(F.col("value"))})


def validate(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """status, confidence and note of each candidate (field, entity, value, unit, quote, derivation, confidence).

    ``plans`` has field and the arrays allowed, keywords and unit_hints; it is a small schema and joined by field.
    Gates come first (plan, derivation, value, evidence); then the evidence is scored.
    """
    plan = plans.select(F.lower("field").alias("_field"), "allowed", "keywords", "unit_hints")
    rows = candidates.join(plan, F.lower("field") == F.col("_field"), "left")
    quote, low = text.strip(F.coalesce("quote", F.lit(""))), F.lower(F.coalesce("quote", F.lit("")))
    points = lambda condition, value: F.when(F.coalesce(condition, F.lit(False)), F.lit(value)).otherwise(0.0)
    score = (
        points(F.length(quote) >= 20, 0.45)
        + points(F.contains(low, F.lower("field")) | F.contains(low, F.lower("entity")), 0.15)
        + points(F.exists("keywords", lambda k: F.contains(low, F.lower(k))), 0.2)
        + points((F.col("unit") != "") & ((F.size("unit_hints") == 0) | F.exists("unit_hints", lambda u: F.endswith(F.lower("unit"), F.lower(u)))), 0.1)
        - points(F.col("derivation") == "computed", 0.2)
    )
    gate = (
        F.when(F.col("_field").isNull(), "no_schema_plan").when(~F.array_contains("allowed", F.col("derivation")), "derivation_type_not_allowed")
        .when(text.strip(F.coalesce("value", F.lit(""))) == "", "empty_value").when(quote == "", "missing_quote")
    )
    rows = rows.withColumns({"_score": F.round(score, 6), "_gate": gate})
    full = (F.col("_score") >= 0.5) | (F.col("confidence") >= 0.5)
    status = F.when(F.col("_gate").isNotNull(), "unsupported").when(full, "sufficient").when(F.col("_score") >= 0.3, "insufficient").otherwise("unsupported")
    sure = (
        F.when(F.col("_gate") == "derivation_type_not_allowed", F.col("confidence")).when(F.col("_gate").isNotNull(), 0.0)
        .when(full, F.least(F.lit(1.0), F.col("confidence") * 1.05)).when(F.col("_score") >= 0.3, F.col("confidence") * 0.6).otherwise(0.0)
    )
    note = F.coalesce("_gate", F.when(full, "supported").when(F.col("_score") >= 0.3, "partially_supported").otherwise("unsupported"))
    return rows.select(*candidates.columns, status.alias("status"), sure.alias("_sure"), note.alias("note")).withColumn("confidence", F.col("_sure")).drop("_sure")


def signature(value: Column, unit: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", F.lower(text.strip(value)), F.lower(text.strip(F.coalesce(unit, F.lit("")))))), 1, 16)


def fuse(candidates: DataFrame) -> DataFrame:
    """One row for each (entity, field) whose candidates agree, all of them marked where they do not.

    Columns: seq (unique), entity, field, value, unit, source, status, confidence. Unsupported candidates are left out.
    Groups are only counted and ranked; no group is ever gathered in one row.
    """
    rows = candidates.where("status <> 'unsupported'").withColumn("_sign", signature(F.col("value"), F.col("unit")))
    keys = ["_entity", "_field"]
    rows = rows.withColumns({"_entity": F.lower(text.strip(F.col("entity"))), "_field": F.lower(text.strip(F.col("field")))})
    best = F.struct(_rank("status", STATES, 0), F.col("confidence"), -_rank("source", SOURCES, 9), -F.col("seq"))
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"), (F.min("_sign") == F.max("_sign")).alias("_same"), F.max_by("seq", best).alias("_top"))
    rows = rows.join(groups, keys).where(~F.col("_same") | (F.col("seq") == F.col("_top")))
    single, merged = F.col("_n") == 1, F.col("_same")
    sure = F.when(single, F.col("confidence")).when(merged, F.least(F.lit(1.0), F.col("confidence") + 0.05)).otherwise(F.col("confidence") * 0.85)
    return rows.select(
        "seq", "entity", "field", "value", "unit", F.when(single, F.col("source")).when(merged, "fusion").otherwise(F.col("source")).alias("source"), sure.alias("confidence"),
        F.when(single, F.col("status")).when(merged, F.when(sure >= 0.55, "sufficient").otherwise("conflicted")).otherwise("conflicted").alias("status"),
        F.when(single, "single_candidate").when(merged, "rule_merge_consistent").otherwise("contradicting_evidence").alias("decision"), (F.col("_n") - 1).alias("others"),
    )


def _grouped(candidates: DataFrame) -> DataFrame:
    """Supported candidates with their group and the sign of their value."""
    rows = candidates.where("status <> 'unsupported'").withColumn("_sign", signature(F.col("value"), F.col("unit")))
    return rows.withColumns({"_entity": F.lower(text.strip(F.col("entity"))), "_field": F.lower(text.strip(F.col("field")))})


def fused_evidence(candidates: DataFrame) -> DataFrame:
    """(seq, evidence): what supports each row of ``fuse``, one row for each, so that a large group is no array.

    A merged value has the evidence of all its candidates, each once, and the ids of all but its own; single and contested
    ones keep their own. ``candidates`` also have evidence_id and supporting (array).
    """
    own = fuse(candidates).select("seq", F.col("decision").alias("_decision"), "entity", "field")
    keys = {"_entity": F.lower(text.strip(F.col("entity"))), "_field": F.lower(text.strip(F.col("field")))}
    chosen = own.withColumns(keys).select("_entity", "_field", "seq", "_decision")
    rows = _grouped(candidates).select("_entity", "_field", F.col("seq").alias("_of"), "evidence_id", "supporting")
    merged = rows.join(chosen.where("_decision = 'rule_merge_consistent'"), ["_entity", "_field"])
    also = F.when((F.col("_of") != F.col("seq")) & (F.coalesce("evidence_id", F.lit("")) != ""), F.array("evidence_id")).otherwise(F.array().cast("array<string>"))
    merged = merged.select("seq", F.explode(F.concat(F.coalesce("supporting", F.array().cast("array<string>")), also)).alias("evidence"))
    kept = candidates.join(chosen.where("_decision <> 'rule_merge_consistent'").select("seq"), "seq", "left_semi").select("seq", F.explode("supporting").alias("evidence"))
    return merged.unionByName(kept).where("evidence is not null and evidence <> ''").distinct()


def rejected_links(candidates: DataFrame) -> DataFrame:
    """(group, seq, identity, n_rejected): contested candidates by group, each with its identity; a candidate rejects all others of its group.

    The list of what a candidate rejects is its group's rows less its own: with n candidates the rows are n and not n * n.
    ``identity`` is the evidence id, else the sign of value and unit.
    """
    contested = fuse(candidates).where("decision = 'contradicting_evidence'").select("seq")
    rows = _grouped(candidates).join(contested, "seq", "left_semi")
    identity = text.coalesce_blank(F.col("evidence_id"), F.col("_sign"))
    rows = rows.select(F.concat_ws("|", "_entity", "_field").alias("group"), "seq", identity.alias("identity"))
    sizes = rows.groupBy("group").agg(F.count("*").alias("_n"))
    return rows.join(sizes, "group").select("group", "seq", "identity", (F.col("_n") - 1).alias("n_rejected"))


def chart_issues(points: DataFrame, low: float | None = None, high: float | None = None, log_y: bool = False, unit: str | None = None, tolerance: float = 0.2) -> DataFrame:
    """(fig, idx, rule, severity) for every rule a point breaks; ``points`` has fig, series, idx, x, y, unit, error_bar.

    All rules of a row are one array of structs, exploded once; what needs a series comes from one window over it.
    """
    own = Window.partitionBy("fig", "series")
    rows = points.withColumns({"_n": F.count("*").over(own), "_m": F.avg("y").over(own), "_sd": F.stddev_pop("y").over(own)})
    issue = lambda condition, rule, severity: F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
    y = F.col("y")
    rules = [issue(F.col("x").isNull() | y.isNull(), "null_value", "error"), issue(F.isnan("x") | F.isnan("y"), "nan_value", "error"), issue(F.col("_n") < 3, "low_density", "warning")]
    rules += [issue((F.col("_sd") > 0) & (F.abs(y - F.col("_m")) / F.col("_sd") > 3), "outlier", "warning"), issue(F.lower("series").isin("series", "data", "series 1", "unknown"), "generic_series_name", "info")]
    rules += [issue(F.col("error_bar").isNotNull() & F.col("error_bar").try_cast("double").isNull(), "error_bar_format", "warning")]
    if log_y:
        rules.append(issue(y <= 0, "log_axis_non_positive", "error"))
    if unit is not None:
        rules.append(issue((F.coalesce("unit", F.lit("")) != "") & (F.lower("unit") != unit.lower()), "unit_mismatch", "warning"))
    if low is not None:
        rules.append(issue(y < low - abs(low) * tolerance, "range_violation", "warning"))
    if high is not None:
        rules.append(issue(y > high + abs(high) * tolerance, "range_violation", "warning"))
    return rows.select("fig", "idx", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("i")).select("fig", "idx", "i.rule", "i.severity")


def chart_verdict(points: DataFrame, issues: DataFrame) -> DataFrame:
    """passed and confidence of each figure: .95 less .15 an error and .05 a warning, not below 0."""
    per = issues.groupBy("fig").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = points.select("fig").distinct().join(per, "fig", "left").fillna(0, ["errors", "warnings"])
    return rows.select("fig", "errors", "warnings", (F.col("errors") == 0).alias("passed"), F.greatest(F.lit(0.0), F.lit(0.95) - F.col("errors") * 0.15 - F.col("warnings") * 0.05).alias("confidence"))


def wide_to_long(tables: DataFrame) -> DataFrame:
    """(label, row, header, cell) of tables given as label, headers and rows; short rows are padded, empty cells dropped."""
    rows = tables.select("label", "headers", F.posexplode("rows").alias("row", "cells"))
    cells = F.transform("headers", lambda h, i: F.struct(h.alias("header"), F.coalesce(F.get("cells", i), F.lit("")).alias("cell")))
    return rows.select("label", "row", F.inline(cells)).where(~text.strip(F.col("cell")).isin("", "-", "—", "N/A"))


def calibrated(points: DataFrame, ticks: DataFrame) -> DataFrame:
    """Values of pixels by each figure's fitted axis: value = a * px + b, or 10 to that power on a logarithmic axis."""
    positive = F.when(F.col("value") > 0, F.col("value"))
    log = numbers.log_scale(F.min(positive), F.max(positive), F.count(positive))
    fit = ticks.groupBy("fig").agg(
        log.alias("log"), F.regr_slope("value", "px").alias("a1"), F.regr_intercept("value", "px").alias("b1"), F.regr_slope(F.log10(positive), "px").alias("a2"), F.regr_intercept(F.log10(positive), "px").alias("b2"),
        F.pow(F.corr("px", "value"), F.lit(2)).alias("r1"), F.pow(F.corr("px", F.log10(positive)), F.lit(2)).alias("r2"),
    )
    value = F.when(F.col("log"), F.pow(F.lit(10.0), F.col("a2") * F.col("px") + F.col("b2"))).otherwise(F.col("a1") * F.col("px") + F.col("b1"))
    return points.join(fit, "fig").select("fig", "px", value.alias("value"), F.when(F.col("log"), "log10").otherwise("linear").alias("scale"), F.coalesce(F.when(F.col("log"), F.col("r2")).otherwise(F.col("r1")), F.lit(0.0)).alias("r2"))


def _candidates(rows):
    source = F.when(F.col("l_returnflag") == "A", "section").when(F.col("l_returnflag") == "N", "table").otherwise("figure")
    status = F.when(F.col("l_tax") < 0.02, "unsupported").when(F.col("l_tax") < 0.05, "insufficient").otherwise("sufficient")
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")))
    return rows.select(F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long").alias("seq"), F.concat(F.lit("E"), F.col("l_partkey").cast("string")).alias("entity"), F.col("l_linestatus").alias("field"),
                       F.floor(F.col("l_quantity") / 20).cast("string").alias("value"), F.lit("mm").alias("unit"), source.alias("source"), status.alias("status"), (F.lit(1.0) - F.col("l_discount")).alias("confidence"))


@BOOK.add("""WITH c AS (SELECT 'E' || l_partkey AS entity, l_linestatus AS field, CAST(CAST(floor(l_quantity / 20) AS BIGINT) AS VARCHAR) AS value, CASE WHEN l_tax < 0.02 THEN 'unsupported' WHEN l_tax < 0.05 THEN 'insufficient' ELSE 'sufficient' END AS status FROM lineitem),
v AS (SELECT * FROM c WHERE status <> 'unsupported'), g AS (SELECT entity, field, count(*) AS n, count(DISTINCT value) AS k FROM v GROUP BY ALL)
SELECT entity, field, CASE WHEN n = 1 THEN 'single_candidate' WHEN k = 1 THEN 'rule_merge_consistent' ELSE 'contradicting_evidence' END AS decision, CAST(CASE WHEN k = 1 THEN 1 ELSE n END AS BIGINT) AS rows FROM g""")
def ext9_fusion_decisions_all(spark, sf_dir):
    return fuse(_candidates(table(spark, sf_dir, "lineitem"))).groupBy("entity", "field", "decision").agg(F.count("*").alias("rows"))


_EVIDENCE_SQL = """WITH c AS (SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey AS seq, 'e' || l_partkey AS entity, l_linestatus AS field, CAST(CAST(floor(l_quantity / 20) AS BIGINT) AS VARCHAR) AS value, CASE WHEN l_tax < 0.02 THEN 'unsupported' WHEN l_tax < 0.05 THEN 'insufficient' ELSE 'sufficient' END AS status,
l_discount AS confidence, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'ev' || l_suppkey END AS evidence_id, CASE WHEN l_linenumber % 4 = 0 THEN [] ELSE ['s' || l_suppkey % 5, 's' || l_linenumber % 2] END AS supporting FROM lineitem),
v AS (SELECT *, count(*) OVER w AS n, min(value) OVER w = max(value) OVER w AS same, row_number() OVER (PARTITION BY entity, field ORDER BY CASE status WHEN 'sufficient' THEN 0 ELSE 1 END, confidence DESC, seq) = 1 AS top FROM c WHERE status <> 'unsupported' WINDOW w AS (PARTITION BY entity, field))"""


def _evidenced(lineitem: DataFrame) -> DataFrame:
    part = lambda c: F.col(c).cast("string")
    supporting = F.when(F.col("l_linenumber") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")), F.concat(F.lit("s"), (F.col("l_linenumber") % 2).cast("string"))))
    status = F.when(F.col("l_tax") < 0.02, "unsupported").when(F.col("l_tax") < 0.05, "insufficient").otherwise("sufficient")
    return lineitem.select(
        F.expr("((l_orderkey * 8L + l_linenumber) * 100000L + l_partkey) * 1000L + l_suppkey").alias("seq"), F.concat(F.lit("E"), part("l_partkey")).alias("entity"), F.col("l_linestatus").alias("field"), F.floor(F.col("l_quantity") / 20).cast("string").alias("value"), F.lit("").alias("unit"), F.lit("text").alias("source"),
        status.alias("status"), F.col("l_discount").cast("double").alias("confidence"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.concat(F.lit("ev"), part("l_suppkey"))).alias("evidence_id"), supporting.alias("supporting"),
    )


@BOOK.add(f"""{_EVIDENCE_SQL}, t AS (SELECT entity, field, seq AS chosen FROM v WHERE top AND same AND n > 1)
SELECT DISTINCT chosen AS seq, evidence FROM (SELECT chosen, unnest(list_concat(supporting, CASE WHEN seq <> chosen AND evidence_id <> '' THEN [evidence_id] ELSE [] END)) AS evidence FROM v JOIN t USING (entity, field)
  UNION ALL SELECT seq, unnest(supporting) FROM v WHERE n = 1 OR NOT same)""")
def ext9_fused_evidence(spark, sf_dir):
    """The union of evidence behind each fused value, over all candidates."""
    return fused_evidence(_evidenced(table(spark, sf_dir, "lineitem")))


@BOOK.add(f"""{_EVIDENCE_SQL}, r AS (SELECT entity || '|' || lower(field) AS "group", seq, coalesce(nullif(evidence_id, ''), substr(sha1(value || '|'), 1, 16)) AS identity FROM v WHERE NOT same)
SELECT "group", seq, identity, count(*) OVER (PARTITION BY "group") - 1 AS n_rejected FROM r""")
def ext9_rejected_links(spark, sf_dir):
    """What contested candidates reject: rows of their groups instead of lists."""
    return rejected_links(_evidenced(table(spark, sf_dir, "lineitem")))


@BOOK.add()
def ext9_fusion(spark, sf_dir):
    return fuse(_candidates(table(spark, sf_dir, "lineitem")))


@BOOK.add("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS value, 's⁻¹' AS unit, p_size::DOUBLE AS normalized_value FROM part""")
def ext6_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("\t")).alias("value"), F.lit(" S^-1 ").alias("unit"))
    return normalize(rows)


@BOOK.add("""WITH p AS (SELECT l_suppkey AS fig, l_linenumber AS series, l_quantity AS y, count(*) OVER w AS n, avg(l_quantity) OVER w AS m, stddev_pop(l_quantity) OVER w AS sd FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_linenumber))
SELECT fig, 'low_density' AS rule, count(*) AS n FROM p WHERE n < 3 GROUP BY fig UNION ALL SELECT fig, 'outlier', count(*) FROM p WHERE sd > 0 AND abs(y - m) / sd > 3 GROUP BY fig UNION ALL SELECT fig, 'range_violation', count(*) FROM p WHERE y > 48 GROUP BY fig""")
def cht1_rules(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("fig"), F.col("l_linenumber").cast("string").alias("series"), F.col("l_orderkey").alias("idx"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.lit("mm").alias("unit"), F.lit(None).cast("string").alias("error_bar")
    )
    return chart_issues(points, high=40.0, unit="mm").groupBy("fig", "rule").agg(F.count("*").alias("n"))


@BOOK.add("""SELECT p_partkey, p_name, p_type, CASE WHEN p_retailprice >= 0.75 * 2000 THEN 'high' WHEN p_retailprice >= 0.5 * 2000 THEN 'medium' ELSE 'low' END AS level FROM part""")
def prj7_confidence(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", text.confidence_level(F.col("p_retailprice") / 2000).alias("level"))


@BOOK.add("""SELECT o_orderkey, CAST(round((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(o_orderdate)) / 1e6) AS BIGINT) AS age_s, greatest(0, least(100, CAST(o_orderkey % 150 AS BIGINT) - 5)) AS progress FROM orders""")
def dt3_age_and_progress(spark, sf_dir):
    age = F.unix_micros(F.lit("2002-01-01").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(age / 1e6).cast("long").alias("age_s"), F.greatest(F.lit(0).cast("long"), F.least(F.lit(100).cast("long"), F.col("o_orderkey") % 150 - 5)).alias("progress"))


@BOOK.add("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def json2_typed_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))
