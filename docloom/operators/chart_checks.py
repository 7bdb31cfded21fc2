"""Digitized charts held to their contracts: ten rules, each giving issues of a figure, a series or a point.

What a rule needs of a whole figure or series is aggregated first and joined to the points, so a figure with very many
points is no single window. Rules of a point are one array of structs that is exploded once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators.charts import CONTRACTS, contracts
from docloom.plans.book import Book, table

BOOK = Book()
#: Penalties, bounds of the rules, how generic names begin, and constraints that are checked here.
BASE, ERROR_COST, WARNING_COST = 0.95, 0.15, 0.05
TOLERANCE, LEAST_POINTS, OUTLIER_POINTS, OUTLIER_SIGMAS, DROPS = 0.2, 3, 5, 3.0, 0.3
GENERIC_STARTS = ("series_", "color_group", "series-")
CONSTRAINT = re.compile(r"([xy])_value\s*(>=|>)\s*([\d.]+)")


def _issue(condition: Column, rule: str, severity: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))


def _contract_rows(figures: DataFrame) -> DataFrame:
    """(fig, x_unit_, y_unit_, x_log, y_log, x_low and the bounds of constraints) of figures (fig, chart_type); unknown types use the general contract.

    Contracts are a table of fixed size; bounds of ``> t`` and ``>= t`` become four columns.
    """
    kinds = [c[0] for c in CONTRACTS]
    kind = F.when(F.col("chart_type").isin(kinds), F.col("chart_type")).otherwise("generic_coordinate_plot")
    known = contracts(figures.sparkSession)
    bounds = {f"{axis}_{name}": F.lit(None).cast("double") for axis in "xy" for name in ("above", "least")}
    for name, *_, rules, _columns in CONTRACTS:
        for found in filter(None, map(CONSTRAINT.fullmatch, rules)):
            column = f"{found[1]}_{'above' if found[2] == '>' else 'least'}"
            bounds[column] = F.when(F.col("chart_type") == name, float(found[3])).otherwise(bounds[column])
    low = F.when(F.col("x_least") > 0, F.col("x_least") * (1 - TOLERANCE)).otherwise(F.col("x_least") - F.abs("x_least") * TOLERANCE)
    known = known.select("chart_type", F.col("x_unit").alias("x_unit_"), F.col("y_unit").alias("y_unit_"), (F.col("x_scale") == "log10").alias("x_log"), (F.col("y_scale") == "log10").alias("y_log"), low.alias("x_low"), *(b.alias(c) for c, b in bounds.items()))
    return figures.select("fig", kind.alias("chart_type")).join(F.broadcast(known), "chart_type").drop("chart_type")


def issues(points: DataFrame, figures: DataFrame, as_given: bool = False) -> DataFrame:
    """(fig, rule, severity, idx, series): ``idx`` names a point, ``series`` a series; both are null for what concerns a figure.

    ``points``: fig, idx, series, x, y, x_unit, y_unit, error_bar; ``figures``: fig, chart_type. Decreases of x are counted
    after sorting by x, where there are none, or, with ``as_given``, in the order of the points. A null series is ``default``.
    """
    names = F.when(F.coalesce("series", F.lit("")) == "", "default").otherwise(F.col("series"))
    y = F.when(F.col("y").isNotNull(), F.col("y"))
    stats = points.groupBy("fig").agg(F.count("y").alias("_n"), F.avg(y).alias("_mean"), F.stddev_pop(y).alias("_sd"))
    rows = points.join(_contract_rows(figures), "fig").join(stats, "fig")
    x, y = F.col("x"), F.col("y")
    empty = x.isNull() | y.isNull()
    said = text.strip(F.coalesce("error_bar", F.lit("")))
    bar = text.strip(F.regexp_replace(said, "^±+", "")).try_cast("double")
    number = lambda c: c.isNotNull() & ~F.isnan(c)
    other = lambda own, wanted: (F.col(wanted) != "") & (text.strip(F.coalesce(own, F.lit(""))) != "") & (text.strip(F.col(own)) != F.col(wanted))
    rules = [
        _issue(empty, "null_value", "error"), _issue(~empty & (F.isnan(x) | F.isnan(y)), "nan_value", "error"), _issue(F.col("x_log") & (x <= 0), "log_axis_non_positive", "error"), _issue(F.col("y_log") & (y <= 0), "log_axis_non_positive", "error"),
        _issue(x < F.col("x_low"), "range_violation", "warning"), _issue(other("x_unit", "x_unit_"), "unit_mismatch", "warning"), _issue(other("y_unit", "y_unit_"), "unit_mismatch", "warning"),
        _issue((F.col("_n") >= OUTLIER_POINTS) & number(F.col("_sd")) & (F.col("_sd") >= 1e-12) & (F.abs(y - F.col("_mean")) / F.col("_sd") > OUTLIER_SIGMAS), "outlier", "info"),
        _issue(bar < 0, "error_bar_negative", "warning"), _issue((said != "") & bar.isNull() & ~F.contains(said, F.lit("±")) & ~F.contains(said, F.lit("/")), "error_bar_format", "info"),
        *(_issue(number(F.col(a)) & (F.col(a) <= F.col(f"{a}_above")), "contract_constraint", "error") for a in "xy"), *(_issue(number(F.col(a)) & (F.col(a) < F.col(f"{a}_least")), "contract_constraint", "error") for a in "xy"),
    ]
    none = lambda kind: F.lit(None).cast(kind)
    idx = points.schema["idx"].dataType
    own = rows.select("fig", "idx", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("i")).select("fig", "i.rule", "i.severity", "idx", none("string").alias("series"))
    series = points.groupBy("fig", names.alias("series")).agg(F.count("*").alias("n"))
    thin = series.where(F.col("n") < LEAST_POINTS).select("fig", F.lit("minimum_density").alias("rule"), F.lit("warning").alias("severity"), none(idx).alias("idx"), "series")
    vague = F.lit(False)
    for start in GENERIC_STARTS:
        vague = vague | F.startswith("series", F.lit(start))
    vague = points.where(vague).select("fig").distinct().select("fig", F.lit("generic_series_name").alias("rule"), F.lit("warning").alias("severity"), none(idx).alias("idx"), none("string").alias("series"))
    out = own.unionByName(thin).unionByName(vague)
    if as_given:
        before = F.lag("x").over(Window.partitionBy("fig", "series").orderBy("idx"))
        runs = points.where("x is not null").select("fig", "idx", "x", names.alias("series")).withColumn("drop", (F.col("x") < before).cast("int"))
        runs = runs.groupBy("fig", "series").agg(F.count("*").alias("n"), F.sum("drop").alias("drops")).where((F.col("n") >= LEAST_POINTS) & (F.col("drops") > DROPS * F.col("n")))
        out = out.unionByName(runs.select("fig", F.lit("monotonicity").alias("rule"), F.lit("warning").alias("severity"), none(idx).alias("idx"), "series"))
    return out


def verdicts(figures: DataFrame, points: DataFrame, found: DataFrame) -> DataFrame:
    """(fig, errors, warnings, passed, confidence) of every figure; one without a point has no confidence."""
    per = found.groupBy("fig").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = figures.select("fig").join(points.groupBy("fig").agg(F.lit(True).alias("some")), "fig", "left").join(per, "fig", "left").fillna(0, ["errors", "warnings"])
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), BASE - (F.col("errors") * ERROR_COST + F.col("warnings") * WARNING_COST)))
    return rows.select("fig", "errors", "warnings", (F.col("errors") == 0).alias("passed"), F.round(F.when(F.col("some"), sure).otherwise(0.0), 6).alias("confidence"))


# --- queries ---
COLUMNS = [
    "event_id % 800 AS fig", "event_id AS idx",
    "CASE WHEN event_id % 1400 = 7 THEN concat('series_', event_id % 3) WHEN event_id % 97 = 0 THEN '' WHEN event_id % 89 = 0 THEN NULL ELSE concat('s', CAST(floor(event_id / 800) AS BIGINT) % 3) END AS series",
    "CASE WHEN event_id % 119 = 0 THEN NULL WHEN event_id % 401 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(event_id % 37 AS DOUBLE) - 1 END AS x", "CASE WHEN event_id % 123 = 0 THEN NULL WHEN event_id % 1013 = 5 THEN CAST('NaN' AS DOUBLE) ELSE value / 10 - 1 END AS y",
    "CASE event_id % 3 WHEN 0 THEN ' s ' WHEN 1 THEN '%' ELSE '' END AS x_unit", "CASE event_id % 4 WHEN 0 THEN 'Pa' WHEN 1 THEN 'mPa·s' WHEN 2 THEN ' ' ELSE NULL END AS y_unit",
    "CASE event_id % 11 WHEN 0 THEN '±0.5' WHEN 1 THEN '-3' WHEN 2 THEN 'n/a' WHEN 3 THEN 'about 2' WHEN 4 THEN ' ' WHEN 5 THEN '± x' WHEN 6 THEN ' 1.5 ' WHEN 7 THEN '±-1' ELSE NULL END AS error_bar",
]
KINDS = f"{[c[0] for c in CONTRACTS] + ['unheard of']}"
ISSUES_SQL = f"""p AS (SELECT {', '.join(COLUMNS)} FROM events), f AS (SELECT DISTINCT fig, {KINDS}[fig % {len(CONTRACTS) + 1} + 1] AS kind FROM p),
k AS (SELECT unnest({[c[0] for c in CONTRACTS]}) AS kind, unnest({[c[2] for c in CONTRACTS]}) AS xu, unnest({[c[6] for c in CONTRACTS]}) AS yu, unnest({[c[3] for c in CONTRACTS]}) AS xs, unnest({[c[7] for c in CONTRACTS]}) AS ys, unnest({[c[4] if c[4] is not None else -1e300 for c in CONTRACTS]}) AS xl, unnest({[';'.join(c[9]) for c in CONTRACTS]}) AS rules),
g AS (SELECT fig, k.* FROM f JOIN k ON k.kind = CASE WHEN f.kind IN (SELECT kind FROM k) THEN f.kind ELSE 'generic_coordinate_plot' END),
s AS (SELECT fig, count(y) AS n, bool_or(isnan(y)) AS nan_, avg(CASE WHEN NOT isnan(y) THEN y END) AS mean, stddev_pop(CASE WHEN NOT isnan(y) THEN y END) AS sd FROM p GROUP BY fig),
j AS (SELECT p.*, g.* EXCLUDE (fig), s.n, s.nan_, s.mean, s.sd, coalesce(trim(error_bar), '') AS said, try_cast(trim(ltrim(coalesce(trim(error_bar), ''), '±')) AS DOUBLE) AS bar FROM p JOIN g USING (fig) JOIN s USING (fig)),
i AS (SELECT fig, 'null_value' AS rule, 'error' AS severity, idx, CAST(NULL AS VARCHAR) AS series FROM j WHERE x IS NULL OR y IS NULL
  UNION ALL SELECT fig, 'nan_value', 'error', idx, NULL FROM j WHERE x IS NOT NULL AND y IS NOT NULL AND (isnan(x) OR isnan(y))
  UNION ALL SELECT fig, 'log_axis_non_positive', 'error', idx, NULL FROM j WHERE xs = 'log10' AND x <= 0 UNION ALL SELECT fig, 'log_axis_non_positive', 'error', idx, NULL FROM j WHERE ys = 'log10' AND y <= 0
  UNION ALL SELECT fig, 'range_violation', 'warning', idx, NULL FROM j WHERE xl > -1e299 AND x < xl * 0.8::DOUBLE
  UNION ALL SELECT fig, 'unit_mismatch', 'warning', idx, NULL FROM j WHERE xu <> '' AND trim(x_unit) <> '' AND trim(x_unit) <> xu UNION ALL SELECT fig, 'unit_mismatch', 'warning', idx, NULL FROM j WHERE yu <> '' AND trim(y_unit) <> '' AND trim(y_unit) <> yu
  UNION ALL SELECT fig, 'outlier', 'info', idx, NULL FROM j WHERE n >= 5 AND NOT nan_ AND sd >= 1e-12 AND abs(y - mean) / sd > 3
  UNION ALL SELECT fig, 'error_bar_negative', 'warning', idx, NULL FROM j WHERE bar < 0 UNION ALL SELECT fig, 'error_bar_format', 'info', idx, NULL FROM j WHERE said <> '' AND bar IS NULL AND NOT contains(said, '±') AND NOT contains(said, '/')
  UNION ALL SELECT fig, 'contract_constraint', 'error', idx, NULL FROM j WHERE (contains(rules, 'x_value > 0') AND x <= 0) OR (contains(rules, 'x_value >= 0') AND x < 0)
  UNION ALL SELECT fig, 'contract_constraint', 'error', idx, NULL FROM j WHERE (contains(rules, 'y_value > 0') AND y <= 0) OR (contains(rules, 'y_value >= 0') AND y < 0)
  UNION ALL SELECT fig, 'minimum_density', 'warning', NULL, coalesce(nullif(series, ''), 'default') FROM p GROUP BY ALL HAVING count(*) < 3
  UNION ALL SELECT DISTINCT fig, 'generic_series_name', 'warning', NULL, NULL FROM p WHERE series LIKE 'series\\_%' ESCAPE '\\')"""


def _inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    points = table(spark, sf_dir, "events").selectExpr(*COLUMNS)
    names = F.array(*(F.lit(c[0]) for c in CONTRACTS), F.lit("unheard of"))
    return points, points.select("fig").distinct().withColumn("chart_type", F.get(names, (F.col("fig") % (len(CONTRACTS) + 1)).cast("int")))


@BOOK.add(f"WITH {ISSUES_SQL} SELECT * FROM i")
def cht1_contract_issues(spark, sf_dir):
    """Every issue of every point, series and figure by the contract of the figure's type."""
    return issues(*_inputs(spark, sf_dir))


@BOOK.add(f"""WITH {ISSUES_SQL}, d AS (SELECT fig, coalesce(nullif(series, ''), 'default') AS series, x, lag(x) OVER (PARTITION BY fig, coalesce(nullif(series, ''), 'default') ORDER BY idx) AS before FROM p WHERE x IS NOT NULL)
SELECT fig, series, count(*) AS n FROM d GROUP BY fig, series HAVING count(*) >= 3 AND count(*) FILTER (x < before) > 0.3 * count(*)""")
def cht1_decreasing_series(spark, sf_dir):
    """Series that run backwards in the order their points were read."""
    points, figures = _inputs(spark, sf_dir)
    found = issues(points, figures, as_given=True).where("rule = 'monotonicity'").select("fig", "series")
    sizes = points.where("x is not null").groupBy("fig", F.when(F.coalesce("series", F.lit("")) == "", "default").otherwise(F.col("series")).alias("series")).agg(F.count("*").alias("n"))
    return found.join(sizes, ["fig", "series"])


@BOOK.add(f"""WITH {ISSUES_SQL}, v AS (SELECT fig, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM i GROUP BY fig)
SELECT fig, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS passed, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.95::DOUBLE - (coalesce(errors, 0) * 0.15::DOUBLE + coalesce(warnings, 0) * 0.05::DOUBLE))), 6) AS confidence FROM f LEFT JOIN v USING (fig)""")
def cht1_verdicts(spark, sf_dir):
    points, figures = _inputs(spark, sf_dir)
    return verdicts(figures, points, issues(points, figures))
