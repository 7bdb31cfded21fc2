"""Each rule on a figure of a few points, with what it finds and what it leaves alone."""

import pytest

from docloom.operators import chart_checks as op

NAN = float("nan")
POINT = "fig int, idx int, series string, x double, y double, x_unit string, y_unit string, error_bar string"
FLOW, LINE, BAR = "rheology_flow_curve", "line_plot", "bar_chart"


def found(spark, kind, rows, **options):
    points = [(1, i, *r, *("s", 1.0, 1.0, None, None, None)[len(r):]) for i, r in enumerate(rows)]
    out = op.issues(spark.createDataFrame(points, POINT), spark.createDataFrame([(1, kind)], "fig int, chart_type string"), **options)
    return sorted((r.rule, r.idx, r.series) for r in out.collect())


OK = [("s", 1.0, 1.0)] * 3


@pytest.mark.parametrize(("kind", "rows", "want"), [
    (LINE, OK, []),
    (LINE, [*OK, ("s", None, 1.0), ("s", NAN, None), ("s", NAN, 1.0), ("s", 1.0, NAN)], [("nan_value", 5, None), ("nan_value", 6, None), ("null_value", 3, None), ("null_value", 4, None)]),
    (FLOW, [*OK, ("s", 0.0, 1.0)], [("contract_constraint", 3, None), ("log_axis_non_positive", 3, None), ("range_violation", 3, None)]),
    (FLOW, [*OK, ("s", 0.0009, 1.0)], []), (FLOW, [*OK, ("s", 0.0007, 1.0)], [("range_violation", 3, None)]),
    (FLOW, [*OK, ("s", 1.0, -1.0, " s⁻¹ ", "Pa")], [("contract_constraint", 3, None), ("log_axis_non_positive", 3, None), ("unit_mismatch", 3, None)]),
    (LINE, [*OK, ("s", 1.0, -1.0, "any", "unit")], []), (BAR, [*OK, ("s", -1.0, 0.0), ("s", 1.0, -0.5)], [("contract_constraint", 4, None)]),
    ("unheard of", [*OK, ("s", -1.0, -1.0)], []),
    (LINE, [("a",), ("a",), ("b",), ("b",), ("b",), (None,)], [("minimum_density", None, "a"), ("minimum_density", None, "default")]),
    (LINE, [("series_1",)] * 3 + [("series-x",)] * 3 + [("my series_",)] * 3, [("generic_series_name", None, None)]),
    (LINE, [("s", 1.0, 0.0)] * 15 + [("s", 1.0, 9.0)], [("outlier", 15, None)]), (LINE, [("s", 1.0, 0.0)] * 3 + [("s", 1.0, 9.0)], []), (LINE, [("s", 1.0, 0.0)] * 15 + [("s", 1.0, 9.0), ("s", 1.0, NAN)], [("nan_value", 16, None)]),
    (LINE, [*OK, *(("s", 1.0, 1.0, None, None, e) for e in ("±2", " ± 0.5 ", "-1", "±-2", "about 3", "1/2", "± x", "", "  ", "3"))], [("error_bar_format", 7, None), ("error_bar_negative", 5, None), ("error_bar_negative", 6, None)]),
])
def test_rules(spark, kind, rows, want):
    assert found(spark, kind, rows) == want


def test_decreases_count_only_in_the_given_order(spark):
    rows = [("s", float(x), 1.0) for x in (5, 4, 3, 2, 9)] + [("t", float(x), 1.0) for x in (1, 2, 3, 1, 5)] + [("u", 2.0, 1.0), ("u", 1.0, 1.0), ("u", None, 1.0)]
    assert [r for r in found(spark, LINE, rows) if r[0] == "monotonicity"] == []
    assert [r for r in found(spark, LINE, rows, as_given=True) if r[0] == "monotonicity"] == [("monotonicity", None, "s")]


def test_verdicts(spark):
    figures = spark.createDataFrame([(1, LINE), (2, FLOW), (3, LINE), (4, LINE)], "fig int, chart_type string")
    points = spark.createDataFrame([(1, i, "s", 1.0, 1.0, None, None, None) for i in range(3)] + [(2, i, "s", 0.0, 0.0, None, None, None) for i in range(4)] + [(3, 0, "a", 1.0, 1.0, None, None, None)], POINT)
    got = {r.fig: (r.errors, r.warnings, r.passed, r.confidence) for r in op.verdicts(figures, points, op.issues(points, figures)).collect()}
    assert got == {1: (0, 0, True, 0.95), 2: (16, 4, False, 0.0), 3: (0, 1, True, 0.9), 4: (0, 0, True, 0.0)}
