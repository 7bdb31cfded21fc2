import hashlib

from docloom.functions import numbers, text
from docloom.operators import extraction as e
from docloom.operators import views
from pyspark.sql import functions as F


def test_validate_gates_and_scores(spark):
    plans = spark.createDataFrame([("Viscosity", ["extractive", "computed"], ["shear"], ["pa·s"])], "field string, allowed array<string>, keywords array<string>, unit_hints array<string>")
    long = "the viscosity under shear was measured"
    rows = [
        (1, "Other", "e", "1", "", long, "extractive", 0.9), (2, "viscosity", "e", "1", "", long, "inferred", 0.9), (3, "viscosity", "e", " ", "", long, "extractive", 0.9), (4, "viscosity", "e", "1", "", " ", "extractive", 0.9),
        (5, "viscosity", "e", "1", "Pa·s", long, "extractive", 0.2), (6, "viscosity", "zz", "1", "", "viscosity shear", "extractive", 0.4), (7, "viscosity", "zz", "1", "", "nothing", "extractive", 0.1), (8, "viscosity", "zz", "1", "", "nothing", "extractive", 0.98),
    ]
    df = spark.createDataFrame(rows, "seq long, field string, entity string, value string, unit string, quote string, derivation string, confidence double")
    got = {r.seq: (r.status, round(r.confidence, 4), r.note) for r in e.validate(df, plans).collect()}
    assert got == {
        1: ("unsupported", 0.0, "no_schema_plan"), 2: ("unsupported", 0.9, "derivation_type_not_allowed"), 3: ("unsupported", 0.0, "empty_value"), 4: ("unsupported", 0.0, "missing_quote"),
        5: ("sufficient", 0.21, "supported"), 6: ("insufficient", 0.24, "partially_supported"), 7: ("unsupported", 0.0, "unsupported"), 8: ("sufficient", 1.0, "supported"),
    }


def test_fusion(spark):
    rows = [
        (1, "A", "f", "5", "mm", "table", "sufficient", 0.5), (2, "a ", "F", " 5", "MM", "section", "sufficient", 0.5), (3, "B", "f", "1", "", "table", "insufficient", 0.9), (4, "C", "f", "1", "", "table", "sufficient", 1.0),
        (5, "C", "f", "2", "", "figure", "insufficient", 0.4), (6, "D", "f", "2", "", "figure", "unsupported", 0.4), (7, "C", "f", "9", "", "figure", "unsupported", 0.4),
    ]
    df = spark.createDataFrame(rows, "seq long, entity string, field string, value string, unit string, source string, status string, confidence double")
    got = {r.seq: (r.decision, r.status, round(r.confidence, 4), r.source) for r in e.fuse(df).collect()}
    assert got == {
        2: ("rule_merge_consistent", "sufficient", 0.55, "fusion"), 3: ("single_candidate", "insufficient", 0.9, "table"), 4: ("contradicting_evidence", "conflicted", 0.85, "table"), 5: ("contradicting_evidence", "conflicted", 0.34, "figure"),
    }
    assert df.select(e.signature(F.col("value"), F.col("unit"))).first()[0] == hashlib.sha1(b"5|mm").hexdigest()[:16]


def test_chart_rules_and_verdict(spark):
    rows = [(1, "a", i, float(i), 1.0, "mm", None) for i in range(20)] + [(1, "a", 20, 5.0, 90.0, "mm", "±x"), (2, "data", 0, None, 1.0, "cm", "0.1"), (2, "data", 1, float("nan"), -1.0, "", None), (3, "b", 0, 1.0, 1.0, "mm", None)]
    df = spark.createDataFrame(rows, "fig int, series string, idx int, x double, y double, unit string, error_bar string")
    issues = e.chart_issues(df, low=0.0, high=50.0, log_y=True, unit="mm")
    got = sorted((r.fig, r.idx, r.rule) for r in issues.collect())
    assert got == sorted([
        (1, 20, "outlier"), (1, 20, "range_violation"), (1, 20, "error_bar_format"), (2, 0, "null_value"), (2, 0, "unit_mismatch"), (2, 0, "low_density"), (2, 0, "generic_series_name"), (2, 1, "nan_value"), (2, 1, "low_density"),
        (2, 1, "generic_series_name"), (2, 1, "log_axis_non_positive"), (2, 1, "range_violation"), (3, 0, "low_density"),
    ])
    verdict = {r.fig: (r.passed, round(r.confidence, 4)) for r in e.chart_verdict(df, issues).collect()}
    assert verdict == {1: (True, 0.8), 2: (False, 0.3), 3: (True, 0.9)}


def test_tables_and_axes(spark):
    wide = spark.createDataFrame([("t", ["a", "b", "c"], [["1", "—", "3"], ["4"]])], "label string, headers array<string>, rows array<array<string>>")
    assert sorted((r.row, r.header, r.cell) for r in e.wide_to_long(wide).collect()) == [(0, "a", "1"), (0, "c", "3"), (1, "a", "4")]
    ticks = spark.createDataFrame([(1, 0.0, 1.0), (1, 100.0, 10.0), (1, 200.0, 100.0), (2, 0.0, 0.0), (2, 10.0, 5.0)], "fig int, px double, value double")
    got = {r.fig: (r.scale, round(r.value, 6)) for r in e.calibrated(spark.createDataFrame([(1, 150.0), (2, 4.0)], "fig int, px double"), ticks).collect()}
    assert got == {1: ("log10", round(10**1.5, 6)), 2: ("linear", 2.0)}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(text.unit(F.lit(u))) for u in (" Pa s ", "mPa·s", "min -1", "kg", "m/s", None)] == ["Pa·s", "mPa·s", "min⁻¹", "kg", "m/s", ""]
    assert [one(numbers.number_text(F.lit(x))) for x in (1.5, 3.0, 0.1234567, None)] == ["1.5", "3", "0.123457", ""]
    assert one(numbers.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert [one(text.claim_type(F.lit(t))) for t in ("It cannot hold", "better than all", "our model", "therefore", "x")] == ["limitation", "comparison", "method", "conclusion", "result"]
    assert one(views.phase_percent(F.lit(1), F.lit(2))) == 60


def test_fusion_takes_all_candidates(spark):
    at = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{at}/lineitem.parquet").where("l_tax >= 0.02")
    want = {(f"e{r.l_partkey}", r.l_linestatus.lower()) for r in lines.select("l_partkey", "l_linestatus").collect()}
    got = e.ext9_fusion(spark, at).select("entity", "field").collect()
    assert {(r.entity.lower(), r.field.lower()) for r in got} == want
