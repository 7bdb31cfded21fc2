"""Digitized charts: axis labels and numbers, contracts by chart type, calibration, verification and quality of points."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators.extraction import chart_issues, chart_verdict
from docloom.plans import derived
from docloom.plans.book import Book, table, written
from docloom.plans.derived import ITEMS, POINTS, cte

BOOK = Book()
#: Superscripts and their digits, and letters in axis labels that are spelled otherwise.
SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹°", "01234567890")
LABEL_LETTERS = ("’‘′″·−", "'''\"*-")
#: Contracts of chart types: x label, unit, scale and least value, then those of y, constraints, further columns.
CONTRACT = "chart_type string, x_label string, x_unit string, x_scale string, x_least double, y_label string, y_unit string, y_scale string, y_least double, constraints array<string>, columns array<string>"
CONTRACTS = [
    ("line_plot", "", "", "linear", None, "", "", "linear", None, [], []),
    ("multi_line_plot", "", "", "linear", None, "", "", "linear", None, [], []),
    ("scatter_plot", "", "", "linear", None, "", "", "linear", None, [], []),
    ("spectrum_curve", "", "", "linear", None, "", "", "linear", None, [], []),
    ("generic_coordinate_plot", "", "", "linear", None, "", "", "linear", None, [], []),
    ("rheology_flow_curve", "Shear rate", "s⁻¹", "log10", 0.001, "Viscosity", "mPa·s", "log10", 0.001, ["x_value > 0", "y_value > 0"], []),
    ("rheology_strain_sweep", "Strain", "%", "log10", 0.001, "Modulus", "Pa", "log10", 0.001, ["x_value > 0", "y_value > 0"], []),
    ("rheology_step_time_sweep", "Time", "s", "linear", None, "Viscosity", "mPa·s", "linear", None, ["x_value >= 0", "y_value > 0"], []),
    ("biphasic_time_series", "Time", "", "linear", None, "", "", "linear", None, [], ["phase"]),
    ("bar_chart", "", "", "", None, "", "", "linear", None, ["y_value >= 0"], []),
    ("grouped_bar", "", "", "", None, "", "", "linear", None, ["y_value >= 0"], []),
    ("bar_or_line_with_errorbar", "", "", "", None, "", "", "linear", None, ["y_value >= 0"], ["error_bar", "significance"]),
    ("heatmap_matrix", "", "", "grid", None, "", "", "grid", None, ["z_value within colorbar_range"], ["z_value", "z_unit"]),
    ("2d_field_map", "", "", "field", None, "", "", "field", None, [], ["z_value", "z_unit"]),
    ("table_image", "", "", "linear", None, "", "", "linear", None, [], []),
    ("microscopy_quant", "", "", "linear", None, "", "", "linear", None, [], ["scale_bar_value", "scale_bar_unit", "pixel_size", "object_class", "object_area_physical", "object_diameter_physical"]),
    ("dual_axis_plot", "", "", "linear", None, "", "", "linear", None, [], ["y_right_value", "y_right_type"]),
]
#: Colours as rules on red, green and blue (hi and lo are the largest and smallest of them); the first that holds.
COLOURS = [
    ("black", "hi < 60"), ("gray", "hi - lo < 40"), ("gray", "lo > 180 and hi - lo < 60"), ("orange", "r > 170 and g > 100 and b < 130 and r > g * 1.1D"), ("brown", "r > 70 and g > 40 and b < 90 and r > g * 1.2D and r > b * 1.8D"),
    ("red", "r > 145 and g < 120 and b < 140 and r > g * 1.2D"), ("blue", "b > r * 1.15D and b > g * 1.15D"), ("green", "g > r * 1.15D and g > b * 1.15D"), ("blue", "b >= r and b >= g"), ("green", "g >= r and g >= b"),
]
#: Microscope channels that a caption may name.
CHANNELS = ["dapi", "fitc", "cy5", "gfp", "rfp", "brightfield"]
#: A constraint on one value: an optional lower bound, the value, a comparison and a bound.
_RULE = re.compile(r"(?:(-?\d+(?:\.\d+)?)\s*(<=?)\s*)?(?:value|[xyz]_value)\s*(<=?|>=?|==|!=)\s*(-?\d+(?:\.\d+)?)")


def contracts(spark: SparkSession) -> DataFrame:
    """The contracts as a table of fixed size; types without one use that of generic_coordinate_plot."""
    return spark.createDataFrame(CONTRACTS, CONTRACT)


def constraint(rule: str, value: Column) -> Column:
    """A constraint such as ``value > 0`` or ``0 <= value < 5`` as a condition; what is no comparison never holds."""
    found = _RULE.fullmatch(rule.strip())
    if not found:
        return F.lit(False)
    compare = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
    out = compare[found[3]](value, F.lit(float(found[4])))
    return out & compare[found[2]](F.lit(float(found[1])), value) if found[1] else out


def penalized(candidates: DataFrame, rules: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """``candidates`` with ``violations``; each that has any is less sure by 15 percent and no longer sufficient but conflicted.

    ``rules``: (field, expected units, constraints); ``candidates``: field, unit, normalized_value, confidence, status.
    """
    fails = F.array().cast("array<string>")
    for name, units, limits in rules:
        own = F.col("field") == name
        found = [F.when(own & (F.coalesce("unit", F.lit("")) != "") & ~F.lower("unit").isin([u.lower() for u in units]), F.concat(F.lit("unit "), "unit"))] if units else []
        found += [F.when(own & F.col("normalized_value").isNotNull() & ~constraint(limit, F.col("normalized_value")), F.lit(limit)) for limit in limits]
        if found:
            fails = F.concat(fails, F.filter(F.array(*found), lambda x: x.isNotNull()))
    rows = candidates.withColumn("violations", fails)
    bad = F.size("violations") > 0
    return rows.withColumns({"confidence": F.when(bad, F.col("confidence") * 0.85).otherwise(F.col("confidence")), "status": F.when(bad & (F.col("status") == "sufficient"), "conflicted").otherwise(F.col("status"))})


def numeric_token(token: Column) -> Column:
    """The number of a tick label: powers of ten, superscripts, letters read for zeros, and 0d for 0.d; null if there is none."""
    raw = text.strip(token)
    plain = F.translate(F.replace(F.replace(raw, F.lit(","), F.lit("")), F.lit("−"), F.lit("-")), *SUPERSCRIPTS)
    clean = F.translate(plain, "Oo", "00")
    allowed = F.regexp_replace(clean, "[^0-9.-]", "")
    power = F.translate(F.substring(raw, 3, 1), *SUPERSCRIPTS).try_cast("int")
    short = ~F.contains(raw, F.lit(".")) & allowed.rlike("^0[1-9]$")
    return (
        F.when(~raw.rlike(f"[0-9{SUPERSCRIPTS[0]}]"), None).when(raw.rlike(f"^10[{SUPERSCRIPTS[0]}]"), F.pow(F.lit(10.0), power))
        .when(clean.startswith("10^"), F.pow(F.lit(10.0), F.substring(clean, 4, 40).try_cast("double"))).when(short, F.concat(F.lit("0."), F.substring(allowed, 2, 1)).try_cast("double")).otherwise(allowed.try_cast("double"))
    )


def axis_label(raw: Column) -> Column:
    """struct(label, unit) of the words on an axis: known quantities by their words, else the words themselves."""
    words = F.transform(F.split(text.collapse(raw), " "), lambda w: F.translate(F.regexp_replace(w, r"^[\[\]{}|,:;]+|[\[\]{}|,:;]+$", ""), *LABEL_LETTERS))
    words = F.filter(words, lambda w: ~F.lower(w).isin("", "legend", "plot", "grid", "flink") & (w.rlike(r"\p{L}|'|%") | F.contains(w, F.lit("^-1"))))
    whole = F.array_join(words, " ")
    low = F.lower(whole)
    has = lambda *parts: reduce(lambda a, b: a & b, (F.contains(low, F.lit(p)) for p in parts))

    def unit(other: str) -> Column:
        out = F.when(has("kpa"), "kPa").when(has("mpa"), "mPa*s")
        out = out.when(has("pa"), "mPa*s" if other == "mPa*s" else "Pa").when(has("s^-1") | has("s-1"), "s^-1").when(has("hour"), "hours")
        seconds = F.exists(F.split(low, " "), lambda w: F.regexp_replace(w, r"^[()]+|[()]+$", "") == "s")
        return out.when(seconds, "s").when(has("%"), "%").otherwise(other)

    named = F.array_join(F.filter(words, lambda w: ~(w.isin("%", "Pa", "mPa*s", "s", "s^-1") | w.startswith("("))), " ")
    pair = lambda name, own: F.struct((F.lit(name) if isinstance(name, str) else name).alias("label"), (F.lit(own) if isinstance(own, str) else own).alias("unit"))
    return (
        F.when(F.size(words) == 0, pair("", "")).when(has("shear", "rate"), pair("Shear rate", unit("s^-1"))).when(has("time"), pair("Time", unit("s"))).when(has("viscosity"), pair("Viscosity", unit("mPa*s")))
        .when(has("strain"), pair("Strain", unit("%"))).when(has("storage", "modulus"), pair("Storage Modulus G'", unit("kPa"))).when(has("g'"), pair("G' and G''", unit("Pa"))).when(has("od", "600"), pair("Bacteria OD600", ""))
        .when(has("phenol"), pair("Phenol", "%")).otherwise(pair(text.coalesce_blank(named, whole), unit("")))
    )


def distinct_ticks(ticks: str, near: float = 8.0) -> Column:
    """Ticks (column of arrays of px, value) by pixel; those nearer than ``near`` to the last one kept are one, with the larger value."""
    kind = "array<struct<px:double,value:double>>"
    return F.expr(f"""aggregate(array_sort(cast({ticks} as {kind})), cast(array() as {kind}), (kept, x) -> case when size(kept) = 0 or abs(element_at(kept, -1).px - x.px) >= {near}D then array_append(kept, x)
        when abs(x.value) > abs(element_at(kept, -1).value) then array_append(slice(kept, 1, size(kept) - 1), x) else kept end)""")


def line_boxes(boxes: str, near: float = 8.0) -> Column:
    """Boxes (column of arrays of y0, x0, y1, x1) from top to bottom, each that starts within ``near`` of the last line's top joined to it."""
    kind = "array<struct<y0:double,x0:double,y1:double,x1:double>>"
    return F.expr(f"""aggregate(array_sort(cast({boxes} as {kind})), cast(array() as {kind}), (kept, x) -> if(size(kept) = 0 or abs(element_at(kept, -1).y0 - x.y0) >= {near}D, array_append(kept, x),
        array_append(slice(kept, 1, size(kept) - 1), named_struct('y0', least(element_at(kept, -1).y0, x.y0), 'x0', least(element_at(kept, -1).x0, x.x0), 'y1', greatest(element_at(kept, -1).y1, x.y1), 'x1', greatest(element_at(kept, -1).x1, x.x1)))))""")


def colour(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """Name of a colour by its parts."""
    hi, lo = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    rule = lambda s: F.expr(re.sub(r"\bhi\b", hi, re.sub(r"\blo\b", lo, re.sub(r"\b([rgb])\b", lambda m: {"r": r, "g": g, "b": b}[m[1]], s))))
    out = F.when(rule(COLOURS[0][1]), COLOURS[0][0])
    return reduce(lambda c, item: c.when(rule(item[1]), item[0]), COLOURS[1:], out).otherwise("red")


def shape_confidence(area: Column, circularity: Column, image_area: Column) -> Column:
    """How sure a shape is one object, by its area and roundness."""
    size = F.when(area < 16, -0.3).when(area < 50, -0.1).when(area > image_area * 0.3, -0.2).otherwise(0.0)
    form = F.when(circularity < 0.2, -0.2).when(circularity > 0.7, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.lit(0.5) + size + form + F.when(area > image_area * 0.01, -0.1).otherwise(0.0)))


def densities(regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc, page, region, text_density, image_density): how full a region is with the characters and pictures of its page.

    ``regions``: doc, page, region, x0, y0, x1, y1; ``boxes``: doc, page, x0, y0, x1, y1, chars (0 for pictures). One equi
    join on the page, in which boxes of one place count together and regions of one place are one row; what lies apart
    counts nothing.
    """
    place = ["doc", "page", "x0", "y0", "x1", "y1"]
    b = boxes.groupBy(*place).agg(F.sum("chars").alias("chars"), F.count_if(F.col("chars") == 0).alias("pictures"))
    b = b.select("doc", "page", *(F.col(c).alias(f"b_{c}") for c in place[2:]), "chars", "pictures")
    wide = F.least("x1", "b_x1") - F.greatest("x0", "b_x0")
    high = F.least("y1", "b_y1") - F.greatest("y0", "b_y0")
    touches = (wide > 0) & (high > 0)
    sums = regions.select(*place).distinct().join(b, ["doc", "page"], "left").groupBy(*place).agg(
        F.sum(F.when(touches, F.col("chars"))).alias("c"), F.sum(F.when(touches & (F.col("pictures") > 0), wide * high * F.col("pictures"))).alias("a")
    )
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in place]
    sums = regions.alias("r").join(sums.alias("s"), same, "left").select("r.*", "s.c", "s.a")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    full = lambda part, whole: F.least(F.lit(1.0), F.coalesce(part, F.lit(0.0)) / whole)
    return sums.select("doc", "page", "region", full(F.col("c").cast("double"), F.greatest(F.lit(80.0), area / 180)).alias("text_density"), full(F.col("a"), F.greatest(F.lit(1.0), area)).alias("image_density"))


def to_pixel(value: Column, low: Column, high: Column, start: Column, size: Column, scale: Column) -> Column:
    """Where a value stands on an axis of pixels from ``start``, ``size`` long (negative: upwards); logarithmic where all are positive."""
    log = (scale == "log10") & (value > 0) & (low > 0)
    share = F.when(log, (F.log10(value) - F.log10(low)) / (F.log10(high) - F.log10(low))).otherwise((value - low) / (high - low))
    return start + share * size


def recalibrated(points: DataFrame, axes: DataFrame, match_score: str = "match_score") -> DataFrame:
    """Values read from a picture, put through its fitted axis where the fit is good: R² above .95 and three ticks or more.

    ``axes``: fig, low, high, scale, start, size, a, b, fit_scale, r2, ticks, match_score; a score below .5 makes all points of the
    figure less sure by a fifth.
    """
    rows = points.join(axes, "fig", "left")
    good = (F.col("r2") > 0.95) & (F.col("ticks") >= 3) & F.col("a").isNotNull() & (F.col("high") > F.col("low"))
    pixel = to_pixel(F.col("x"), F.col("low"), F.col("high"), F.col("start"), F.col("size"), F.col("scale"))
    line = F.col("a") * pixel + F.col("b")
    value = F.when(F.col("fit_scale") == "log10", F.pow(F.lit(10.0), line)).otherwise(line)
    sure = F.when(F.col(match_score) < 0.5, F.round(F.col("confidence") * 0.8, 3)).otherwise(F.col("confidence"))
    good = F.coalesce(good & F.col("x").isNotNull(), F.lit(False))
    return rows.select(*points.columns, F.when(good, F.round(value, 5)).otherwise(F.col("x")).alias("value"), F.when(good, "cv_calibrated").otherwise("vlm_direct").alias("method"), sure.alias("sure"))


def pixels_to_values(pixels: DataFrame, fits: DataFrame) -> DataFrame:
    """Values of pixels by the fitted axes of their figure; without a fit the share of the plot area.

    ``pixels``: fig, px, py; ``fits``: fig, x0, y0, x1, y1 and a, b, scale of each of x, y and y2 (all null without a fit). On the right
    half of the area a second axis gives a further value.
    """
    rows = pixels.join(fits, "fig")
    line = lambda p, c: F.when(F.col(f"{p}_scale") == "log10", F.pow(F.lit(10.0), F.col(f"{p}_a") * F.col(c) + F.col(f"{p}_b"))).otherwise(F.col(f"{p}_a") * F.col(c) + F.col(f"{p}_b"))
    wide, high = F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")), F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    x, y = F.coalesce(line("x", "px"), (F.col("px") - F.col("x0")) / wide), F.coalesce(line("y", "py"), 1 - (F.col("py") - F.col("y0")) / high)
    right = F.when(F.col("px") >= (F.col("x0") + F.col("x1")) / 2, line("y2", "py"))
    kind = lambda p: F.when(F.col(f"{p}_a").isNull(), "normalized").otherwise(F.col(f"{p}_scale"))
    fitted = F.col("x_a").isNotNull() | F.col("y_a").isNotNull()
    return rows.select(*pixels.columns, F.round(x, 5).alias("x"), F.round(y, 5).alias("y"), F.round(right, 5).alias("y_right"), kind("x").alias("x_type"), kind("y").alias("y_type"), F.when(fitted, "ocr_ticks").otherwise("normalized_fallback").alias("method"))


def axis_checks(stated: DataFrame, ticks: DataFrame) -> DataFrame:
    """(fig, axis, score, ticks, r2, ok): stated ranges held against ticks, with the squared correlation of the ticks.

    ``stated``: fig, axis, low, high; ``ticks``: fig, axis, px, value, scale. Two ticks are needed to compare, three for r2.
    """
    log = F.col("scale") == "log10"
    v = F.when(~log, F.col("value")).when(F.col("value") > 0, F.log10("value"))
    p = F.when(v.isNotNull(), F.col("px"))
    own = ticks.groupBy("fig", "axis").agg(F.count("*").alias("n"), F.min("value").alias("t0"), F.max("value").alias("t1"), F.count(v).alias("used"), F.corr(p, v).alias("r"))
    rows = stated.join(own, ["fig", "axis"], "left")
    shared = F.least("high", "t1") - F.greatest("low", "t0")
    union = F.greatest("high", "t1") - F.least("low", "t0")
    score = F.round(F.when((F.col("n") >= 2) & (union > 0), shared / union).otherwise(0.5), 3)
    r2 = F.when((F.col("used") >= 3) & ~F.isnan("r"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pow("r", F.lit(2)))))
    return rows.select("fig", "axis", score.alias("score"), F.coalesce("n", F.lit(0)).alias("ticks"), F.coalesce(r2, F.lit(0.0)).alias("r2"), (score > 0.5).alias("ok"))


def quality_notes(rows: DataFrame) -> DataFrame:
    """``rows`` with sure and data_quality, by how an axis was calibrated and what kind of picture it is."""
    method, kind = F.coalesce("method", F.lit("")), F.coalesce("image_type", F.lit(""))
    sure = (
        F.when(method == "mineru_chart_table", 0.86).when(kind == "multi_panel_composite", 0.9).when(kind == "rheology_flow_curve", F.coalesce(F.nullif("axis_confidence", F.lit(0.0)), F.lit(0.62)))
        .when(method == "known_log_axis", 0.9).when(method == "ocr_ticks", 0.72).otherwise(F.coalesce("confidence", F.lit(0.35)))
    )
    return rows.withColumns({"sure": sure, "data_quality": F.when(method == "mineru_chart_table", "mineru_chart_table_bound").otherwise("standard")})


def point_quality(points: DataFrame) -> DataFrame:
    """``points`` with sure, tags, needs_review and reason by the rules of their family: penalties multiply, each leaves a tag."""
    c = F.col
    none = lambda name: F.coalesce(c(name).cast("string"), F.lit("")) == ""
    zero = lambda name: F.coalesce(c(name), F.lit(0.0)) == 0
    rules = {
        "data_chart": [
            ("missing_x_value", 0.5, c("x").isNull()), ("missing_y_value", 0.5, c("y").isNull() & zero("band_intensity")), ("missing_x_axis_label", 0.8, none("x_unit") & none("x_label")),
            ("missing_y_axis_label", 0.8, none("y_unit") & none("y_label")), ("normalized_axis_only", 0.85, c("x_axis_type").isin("pixel", "normalized")),
        ],
        "microscopy": [
            ("no_scale_bar_calibration", 0.6, zero("pixel_size")), ("no_objects_detected", 0.4, (c("object_count") == 0) & none("description")), ("high_object_count_needs_review", 0.7, c("object_count") > 200),
            ("channel_not_detected", 0.9, none("channel")), ("object_diameter_not_computed", 0.8, zero("diameter") & ~zero("pixel_size")), ("object_class_unverified", 0.8, none("object_class") | (c("object_class") == "unclassified_object_review")),
        ],
        "protein_assay": [
            ("missing_band_intensity", 0.5, c("band_intensity").isNull() & none("qualitative")), ("molecular_weight_not_detected", 0.85, c("molecular_weight").isNull()), ("target_protein_not_identified", 0.8, none("target_protein")),
            ("no_loading_control_detected", 0.9, none("loading_control")),
        ],
    }
    family = F.when(c("family").isin([*rules, "non_data_visual"]), c("family")).otherwise("data_chart")
    base = F.greatest(F.lit(0.5), c("confidence") * 1.2)
    empty = none("description") & none("qualitative")
    sure, tags = F.when(family == "non_data_visual", F.when(empty, 0.1).otherwise(F.greatest(F.lit(0.3), c("confidence") * 0.8))), F.when(family == "non_data_visual", F.filter(F.array(F.lit("non_data_visual_descriptive"), F.when(empty, "empty_description")), lambda t: t.isNotNull()))
    for name, own in rules.items():
        product = reduce(lambda a, rule: a * F.when(rule[2], rule[1]).otherwise(1.0), own, base)
        sure = sure.when(family == name, F.least(F.lit(1.0), F.greatest(F.lit(0.1), product)))
        tags = tags.when(family == name, F.filter(F.array(*(F.when(rule, tag) for tag, _, rule in own)), lambda t: t.isNotNull()))
    rows = points.withColumns({"_sure": sure, "tags": tags})
    review = (F.col("_sure") < 0.4) | F.array_contains("tags", "no_scale_bar_calibration") | F.array_contains("tags", "missing_x_value")
    reason = F.when(review, F.when(F.size("tags") > 0, F.array_join(F.slice("tags", 1, 3), ";")).otherwise("quality_below_threshold")).otherwise("")
    return rows.withColumns({"sure": F.round("_sure", 3), "needs_review": review, "reason": reason}).drop("_sure")


def merged_markers(points: DataFrame, markers: DataFrame, near: float = 6.0, least_area: int = 35) -> DataFrame:
    """(fig, marker): markers that no point of the figure is near; gray and small ones are left out.

    Both sides are dealt by cells as wide as ``near`` and a point goes to the nine cells around it, so the join is on equal cells.
    """
    cell = lambda c: F.floor(F.col(c) / near)
    around = F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))
    spread = points.select("fig", F.col("px").alias("p_px"), F.col("py").alias("p_py"), cell("px").alias("cx"), cell("py").alias("cy")).withColumn("dx", around).withColumn("dy", around)
    spread = spread.select("fig", "p_px", "p_py", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    rows = markers.where((F.col("colour") != "gray") & (F.col("area") >= least_area)).withColumns({"cx": cell("px"), "cy": cell("py")})
    close = (F.abs(F.col("p_px") - F.col("px")) < near) & (F.abs(F.col("p_py") - F.col("py")) < near)
    same = (rows["fig"] == spread["fig"]) & (rows["cx"] == spread["cx"]) & (rows["cy"] == spread["cy"])
    return rows.join(spread, same & close, "left_anti").select("fig", "marker")


def near_pairs(marks: DataFrame, near: float = 6.0) -> DataFrame:
    """(fig, early, late): marks (fig, marker, px, py) of a figure less than ``near`` apart on both axes, by number.

    Marks are dealt by cells as wide as ``near``, and a mark goes to the nine cells around it, so the join is on equal cells.
    """
    cell = lambda c: F.floor(F.col(c) / near)
    around = F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))
    rows = marks.select("fig", "marker", "px", "py", cell("px").alias("cx"), cell("py").alias("cy"))
    spread = rows.select("fig", F.col("marker").alias("late"), F.col("px").alias("qx"), F.col("py").alias("qy"), "cx", "cy").withColumn("dx", around).withColumn("dy", around)
    spread = spread.select("fig", "late", "qx", "qy", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    close = (F.col("marker") < F.col("late")) & (F.abs(F.col("px") - F.col("qx")) < near) & (F.abs(F.col("py") - F.col("qy")) < near)
    return rows.join(spread, ["fig", "cx", "cy"]).where(close).select("fig", F.col("marker").alias("early"), "late")


def suppressed_markers(points: DataFrame, markers: DataFrame, near: float = 6.0, least_area: int = 35) -> DataFrame:
    """(fig, marker): the markers that stay when they are taken in order of their numbers, each that is near a point or one taken before left out.

    Gray and small ones are left out, too. In rounds: what has no undecided marker before it nearby is taken, and what is
    near one taken is left out. Rounds grow with the longest run of markers that wait for each other, not with their
    number. Markers at one place are one (only their first can be taken), so pixels bound how many are near a marker.
    """
    free = markers.join(merged_markers(points, markers, near, least_area), ["fig", "marker"], "left_semi")
    left = written(free.groupBy("fig", "px", "py").agg(F.min("marker").alias("marker")), "markers")
    pairs, taken = written(near_pairs(left, near), "pairs"), None
    while True:
        now = left.join(pairs.select("fig", F.col("late").alias("marker")).distinct(), ["fig", "marker"], "left_anti").select("fig", "marker")
        now = written(now, "taken")
        taken = now if taken is None else taken.union(now)
        if pairs.isEmpty():
            return taken
        out = pairs.join(now.withColumnRenamed("marker", "early"), ["fig", "early"], "left_semi").select("fig", F.col("late").alias("marker")).distinct()
        decided = written(now.union(out), "decided")
        left = left.join(decided, ["fig", "marker"], "left_anti").select(*left.columns)
        for end in ("early", "late"):
            pairs = pairs.join(decided.withColumnRenamed("marker", end), ["fig", end], "left_anti").select("fig", "early", "late")
        left, pairs = written(left, "markers"), written(pairs, "pairs")


def series_issues(points: DataFrame) -> DataFrame:
    """(series, issue, severity) of whole series: impossible ranges, negative values, both axes at once, too few points."""
    named = points.where(F.coalesce("series", F.lit("")) != "")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    right = F.col("y_right").isNotNull()
    per = named.groupBy("series").agg(F.min(y).alias("low"), F.max(y).alias("high"), F.count(x).alias("n"), F.bool_or(right).alias("right"), F.bool_or(~right).alias("left"))
    share = F.contains("series", F.lit("%")) | F.contains(F.lower("series"), F.lit("percent"))
    issue = lambda condition, name, severity: F.when(condition, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity")))
    found = [
        issue(F.contains("series", F.lit("OD")) & (F.col("high") > 5), "dual_y_axis_confusion", "CRITICAL"), issue(share & (F.col("high") < 1) & (F.col("high") > 0), "legend_mapping_error", "CRITICAL"),
        issue(share & (F.col("high") > 100), "value_out_of_range", "WARNING"), issue(F.col("low") < 0, "negative_value", "WARNING"), issue(F.col("left") & F.col("right"), "axis_binding_conflict", "CRITICAL"),
        issue(F.col("n") < 5, "insufficient_data_points", "WARNING"),
    ]
    return per.select("series", F.explode(F.filter(F.array(*found), lambda i: i.isNotNull())).alias("i")).select("series", "i.issue", "i.severity")


def caption_warnings(rows: DataFrame) -> DataFrame:
    """``rows`` with warnings and needs_review: what the caption says of scale bars, channels and panels against what was extracted.

    ``rows``: caption, scale_bar, channel, panels (array of labels), panel_count.
    """
    low = F.lower(F.coalesce("caption", F.lit("")))
    named = F.filter(F.array(*(F.when(F.contains(low, F.lit(ch)), ch) for ch in CHANNELS)), lambda x: x.isNotNull())
    channel = F.lower(F.coalesce("channel", F.lit("")))
    found = F.array(
        F.when(F.contains(low, F.lit("scale bar")) & F.col("scale_bar").isNull(), "caption_mentions_scale_bar_but_no_scale_bar_detected"),
        F.when((F.size(named) > 0) & ~F.array_contains(named, channel), F.concat(F.lit("caption_mentions_channels_"), F.array_join(named, ","), F.lit("_but_channel_is_"), text.coalesce_blank(channel, F.lit("not_set")))),
        F.when((F.size("panels") > 0) & (F.coalesce("panel_count", F.lit(1)) < F.size("panels")), F.concat(F.lit("caption_has_"), F.size("panels").cast("string"), F.lit("_panel_labels_but_only_"), F.coalesce("panel_count", F.lit(1)).cast("string"), F.lit("_extracted"))),
    )
    return rows.withColumn("warnings", F.array_join(F.filter(found, lambda w: w.isNotNull()), ";")).withColumn("needs_review", F.col("warnings") != "")


def panel_labels(caption: Column) -> Column:
    """Letters of the panels named in brackets: (A, b) gives A and B."""
    groups = F.regexp_extract_all(F.coalesce(caption, F.lit("")), F.lit(r"\(([a-zA-Z](?:\s*[,;]\s*[a-zA-Z])*)\)"), F.lit(1))
    return F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*[,;]\s*"))), lambda p: F.upper(F.trim(p)))


# --- queries ---
@BOOK.add(f"""WITH {cte('i', ITEMS)}, k AS (SELECT unnest({[c[0] for c in CONTRACTS]}) AS kind, unnest({[c[3] for c in CONTRACTS]}) AS x_scale, unnest({[len(c[9]) for c in CONTRACTS]}) AS n_constraints, unnest({[15 + len(c[10]) if c[0] != 'table_image' else 0 for c in CONTRACTS]}) AS n_columns)
SELECT i.id, k.kind AS chart_type, x_scale, CAST(n_constraints AS INTEGER) AS n_constraints, CAST(n_columns AS INTEGER) AS n_columns FROM i JOIN k ON k.kind = CASE WHEN lower(trim(image_type)) IN (SELECT kind FROM k) THEN lower(trim(image_type)) ELSE 'generic_coordinate_plot' END""")
def udf4_chart_contracts(spark, sf_dir):
    """The contract of each item by its image type, with the number of its columns: fifteen that all have and their own; pictures of tables have none."""
    known = contracts(spark).select("chart_type", "x_scale", F.size("constraints").alias("n_constraints"), F.when(F.col("chart_type") == "table_image", 0).otherwise(F.size("columns") + 15).alias("n_columns"))
    kind = F.lower(F.trim("image_type"))
    rows = derived.rows(spark, sf_dir, ITEMS).select("id", F.when(kind.isin([c[0] for c in CONTRACTS]), kind).otherwise("generic_coordinate_plot").alias("chart_type"))
    return rows.join(F.broadcast(known), "chart_type").select("id", "chart_type", "x_scale", "n_constraints", "n_columns")  # a table of fixed size


_CANDIDATES = """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'viscosity' WHEN 1 THEN 'yield' ELSE 'free' END AS field, CASE p_size % 4 WHEN 0 THEN 'Pa' WHEN 1 THEN 'mPa' WHEN 2 THEN '' ELSE NULL END AS unit,
CAST(p_size - 25 AS DOUBLE) AS normalized_value, CAST(8 AS DOUBLE) / 10 AS confidence, CASE WHEN p_size % 2 = 0 THEN 'sufficient' ELSE 'insufficient' END AS status FROM part"""


@BOOK.add(f"""WITH c AS ({_CANDIDATES}), v AS (SELECT *, list_filter([CASE WHEN field = 'viscosity' AND unit <> '' AND lower(unit) NOT IN ('pa','pa·s') THEN 'unit ' || unit END, CASE WHEN field = 'viscosity' AND NOT normalized_value > 0 THEN 'value > 0' END,
CASE WHEN field = 'yield' AND NOT (0 <= normalized_value AND normalized_value < 15) THEN '0 <= value < 15' END], lambda x: x IS NOT NULL) AS bad FROM c)
SELECT id, array_to_string(bad, ';') AS violations, round(CASE WHEN len(bad) > 0 THEN confidence * 0.85::DOUBLE ELSE confidence END, 6) AS confidence, CASE WHEN len(bad) > 0 AND status = 'sufficient' THEN 'conflicted' ELSE status END AS status FROM v""")
def ext10_contract_penalty(spark, sf_dir):
    rules = [("viscosity", ["Pa", "Pa·s"], ["value > 0"]), ("yield", [], ["0 <= value < 15"])]
    rows = table(spark, sf_dir, "part").selectExpr(*_columns(_CANDIDATES))
    return penalized(rows, rules).select("id", F.array_join("violations", ";").alias("violations"), F.round("confidence", 6).alias("confidence"), "status")


def _columns(select: str) -> list[str]:
    """The columns of a SELECT from one table, as expressions; commas within brackets or CASE stay."""
    body, out, depth, held = select[len("SELECT") : select.rindex("FROM")], [], 0, ""
    for part in re.split(r"(,|\(|\)|\bCASE\b|\bEND\b)", body):
        depth += (part in ("(", "CASE")) - (part in (")", "END"))
        if part == "," and depth == 0:
            out, held = [*out, held.strip()], ""
        else:
            held += part
    return [*out, held.strip()]


@BOOK.add("""WITH r AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM (SELECT p_partkey AS id, (p_partkey * 37 + p_size * 11) % 256 AS r, (p_partkey * 91 + 7) % 256 AS g, (p_partkey * 53 + p_size) % 256 AS b FROM part))
SELECT id, CASE WHEN hi < 60 THEN 'black' WHEN hi - lo < 40 THEN 'gray' WHEN lo > 180 AND hi - lo < 60 THEN 'gray' WHEN r > 170 AND g > 100 AND b < 130 AND r > g * 1.1::DOUBLE THEN 'orange' WHEN r > 70 AND g > 40 AND b < 90 AND r > g * 1.2::DOUBLE AND r > b * 1.8::DOUBLE THEN 'brown'
WHEN r > 145 AND g < 120 AND b < 140 AND r > g * 1.2::DOUBLE THEN 'red' WHEN b > r * 1.15::DOUBLE AND b > g * 1.15::DOUBLE THEN 'blue' WHEN g > r * 1.15::DOUBLE AND g > b * 1.15::DOUBLE THEN 'green' WHEN b >= r AND b >= g THEN 'blue' WHEN g >= r AND g >= b THEN 'green' ELSE 'red' END AS colour FROM r""")
def math11_mark_colour(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "(p_partkey * 37 + p_size * 11) % 256 AS r", "(p_partkey * 91 + 7) % 256 AS g", "(p_partkey * 53 + p_size) % 256 AS b")
    return rows.select("id", colour().alias("colour"))


@BOOK.add("""WITH s AS (SELECT p_partkey AS id, CAST(p_size * p_partkey % 5000 AS BIGINT) AS area, (p_size % 10) / 10.0::DOUBLE AS c FROM part) SELECT id, round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE
+ CASE WHEN area < 16 THEN -0.3::DOUBLE WHEN area < 50 THEN -0.1::DOUBLE WHEN area > 3000 THEN -0.2::DOUBLE ELSE 0 END + CASE WHEN c < 0.2::DOUBLE THEN -0.2::DOUBLE WHEN c > 0.7::DOUBLE THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN area > 100 THEN -0.1::DOUBLE ELSE 0 END)), 6) AS sure FROM s""")
def math12_shape_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size * p_partkey % 5000 AS area", "(p_size % 10) / 10.0D AS c")
    return rows.select("id", F.round(shape_confidence(F.col("area"), F.col("c"), F.lit(10_000.0)), 6).alias("sure"))


_BOXES = "p_partkey % 20 AS doc, p_partkey % 3 AS page, CAST(p_size * 7 % 300 AS DOUBLE) AS x0, CAST(p_size * 11 % 500 AS DOUBLE) AS y0, p_partkey AS id"


@BOOK.add(f"""WITH p AS (SELECT {_BOXES}, p_size FROM part), r AS (SELECT *, x0 + 200 AS x1, y0 + 150 AS y1 FROM p), b AS (SELECT doc, page, x0 AS bx0, y0 AS by0, x0 + 120 AS bx1, y0 + 40 AS by1, CASE WHEN p_size % 2 = 0 THEN p_size * 10 ELSE 0 END AS chars FROM p),
j AS (SELECT r.id, least(x1, bx1) - greatest(x0, bx0) AS w, least(y1, by1) - greatest(y0, by0) AS h, chars FROM r JOIN b USING (doc, page))
SELECT id AS region, round(least(1, coalesce(sum(chars) FILTER (w > 0 AND h > 0), 0) / (200 * 150 / 180.0::DOUBLE)), 6) AS text_density, round(least(1, coalesce(sum(w * h) FILTER (w > 0 AND h > 0 AND chars = 0), 0) / 30000.0::DOUBLE), 6) AS image_density FROM j GROUP BY id""")
def math13_densities(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr(*_BOXES.split(", "), "p_size")
    regions = rows.select("doc", "page", F.col("id").alias("region"), "x0", "y0", (F.col("x0") + 200).alias("x1"), (F.col("y0") + 150).alias("y1"))
    boxes = rows.select("doc", "page", "x0", "y0", (F.col("x0") + 120).alias("x1"), (F.col("y0") + 40).alias("y1"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 10).otherwise(0).alias("chars"))
    out = densities(regions, boxes)
    return out.select("region", F.round("text_density", 6).alias("text_density"), F.round("image_density", 6).alias("image_density"))


_TOKENS = "CASE p_size % 9 WHEN 0 THEN '1,2OO' WHEN 1 THEN '10⁴' WHEN 2 THEN '10^-2' WHEN 3 THEN '05' WHEN 4 THEN '−3.5 Pa' WHEN 5 THEN 'none' WHEN 6 THEN '0.25' WHEN 7 THEN concat(p_size, ' kg') ELSE '--' END"


@BOOK.add("""SELECT p_partkey AS id, CASE p_size % 9 WHEN 0 THEN 1200.0::DOUBLE WHEN 1 THEN 10000 WHEN 2 THEN 0.01 WHEN 3 THEN 0.5 WHEN 4 THEN -3.5 WHEN 6 THEN 0.25 WHEN 7 THEN CASE WHEN p_size < 10 THEN p_size / 1.0 ELSE p_size END END AS number FROM part""")
def str17_numeric_token(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_TOKENS).alias("t")).select(F.col("p_partkey").alias("id"), F.round(numeric_token(F.col("t")), 9).alias("number"))


@BOOK.add("""SELECT p_partkey AS id, ['Shear rate','Time','Viscosity','Storage Modulus G''','Bacteria OD600','Phenol','Loss factor','','G'' and G''''','Force'][p_size % 10 + 1] AS label, ['s^-1','hours','mPa*s','kPa','','%','','','Pa','s'][p_size % 10 + 1] AS unit FROM part""")
def str21_axis_label(spark, sf_dir):
    raw = F.element_at(F.array(*(F.lit(s) for s in ("[Shear rate] (s^-1)", "Time, hours", "Viscosity | Pa*s", "storage modulus kPa", "OD600 value", "Phenol content", "Loss factor", "legend 12 34", "G’ Pa", "Force (s)"))), (F.col("p_size") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), axis_label(raw).alias("a")).select("id", "a.label", "a.unit")


@BOOK.add(f"""WITH {cte('p', POINTS)}, g AS (SELECT series, min(coalesce(y, 0)) AS low, max(coalesce(y, 0)) AS high, count(*) AS n, bool_or(y_right IS NOT NULL) AND bool_or(y_right IS NULL) AS twice FROM p WHERE series <> '' GROUP BY series)
SELECT series, 'dual_y_axis_confusion' AS issue, 'CRITICAL' AS severity FROM g WHERE contains(series, 'OD') AND high > 5 UNION ALL SELECT series, 'legend_mapping_error', 'CRITICAL' FROM g WHERE contains(series, '%') AND high < 1 AND high > 0
UNION ALL SELECT series, 'value_out_of_range', 'WARNING' FROM g WHERE contains(series, '%') AND high > 100 UNION ALL SELECT series, 'negative_value', 'WARNING' FROM g WHERE low < 0 UNION ALL SELECT series, 'axis_binding_conflict', 'CRITICAL' FROM g WHERE twice
UNION ALL SELECT series, 'insufficient_data_points', 'WARNING' FROM g WHERE n < 5""")
def cht3_series_issues(spark, sf_dir):
    return series_issues(derived.rows(spark, sf_dir, POINTS))


def score(issues: DataFrame, by: str) -> DataFrame:
    """(by, score, passed): 1 less .3 a critical issue, .1 a warning and .05 any other, not below 0."""
    s = F.col("severity")
    lost = F.sum(F.when(s == "CRITICAL", 0.3).when(s == "WARNING", 0.1).otherwise(0.05))
    return issues.groupBy(by).agg(F.round(F.greatest(F.lit(0.0), 1 - lost), 6).alias("score"), (F.count_if(s == "CRITICAL") == 0).alias("passed"))


@BOOK.add("""SELECT user_id % 40 AS fig, round(greatest(0, 1 - sum(CASE event_type WHEN 'error' THEN 0.3::DOUBLE WHEN 'click' THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END)), 6) AS score, count(*) FILTER (event_type = 'error') = 0 AS passed FROM events WHERE value > 150 GROUP BY 1""")
def math10_penalty_score(spark, sf_dir):
    severity = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "click", "WARNING").otherwise("INFO")
    return score(table(spark, sf_dir, "events").where("value > 150").select((F.col("user_id") % 40).alias("fig"), severity.alias("severity")), "fig")


@BOOK.add(f"""WITH {cte('p', POINTS)}, q AS (SELECT fig, series, count(*) AS n, count(*) FILTER (x IS NULL OR y IS NULL) AS bad, avg(y) AS m, stddev_pop(y) AS sd FROM p GROUP BY fig, series),
o AS (SELECT p.fig, count(*) FILTER (q.n < 3) + count(*) FILTER (sd > 0 AND abs(y - m) / sd > 3) AS warnings, count(*) FILTER (x IS NULL OR y IS NULL) AS errors FROM p JOIN q USING (fig, series) GROUP BY p.fig)
SELECT fig, errors, warnings, errors = 0 AS passed, round(greatest(0, 0.95::DOUBLE - errors * 0.15::DOUBLE - warnings * 0.05::DOUBLE), 6) AS confidence FROM o""")
def cht2_verdict(spark, sf_dir):
    """Whether each figure passes and how sure it is, from the issues of its points."""
    points = derived.rows(spark, sf_dir, POINTS).select("fig", "series", F.col("id").alias("idx"), "x", "y", F.lit("").alias("unit"), F.lit(None).cast("string").alias("error_bar"))
    return chart_verdict(points, chart_issues(points)).withColumn("confidence", F.round("confidence", 6))


_AXES = "fig, CAST(0 AS DOUBLE) AS low, CAST(CASE WHEN fig % 7 = 0 THEN 0 ELSE 37 END AS DOUBLE) AS high, 'linear' AS scale, CAST(50 AS DOUBLE) AS start, CAST(400 AS DOUBLE) AS size, CASE WHEN fig % 11 = 0 THEN NULL ELSE CAST(fig AS DOUBLE) / 200 END AS a, CAST(1 AS DOUBLE) AS b, CASE WHEN fig % 2 = 0 THEN 'linear' ELSE 'log10' END AS fit_scale, CAST(90 + fig % 10 AS DOUBLE) / 100 AS r2, 2 + fig % 3 AS ticks, CAST(fig % 10 AS DOUBLE) / 10 AS match_score"


@BOOK.add(f"""WITH {cte('p', POINTS)}, f AS (SELECT {_AXES} FROM (SELECT DISTINCT fig FROM p WHERE fig < 35)), j AS (SELECT p.id, x, confidence, f.* FROM p LEFT JOIN f USING (fig)),
k AS (SELECT *, coalesce(r2 > 0.95::DOUBLE AND ticks >= 3 AND a IS NOT NULL AND high > low AND x IS NOT NULL, false) AS good, a * (start + (x - low) / nullif(high - low, 0) * size) + b AS line FROM j)
SELECT id, CASE WHEN good THEN round(CASE fit_scale WHEN 'log10' THEN pow(10, line) ELSE line END, 5) ELSE x END AS value, CASE WHEN good THEN 'cv_calibrated' ELSE 'vlm_direct' END AS method, CASE WHEN match_score < 0.5::DOUBLE THEN round(confidence * 0.8::DOUBLE, 3) ELSE confidence END AS sure FROM k""")
def cht4_recalibrated(spark, sf_dir):
    points = derived.rows(spark, sf_dir, POINTS).select("id", "fig", "x", "confidence")
    axes = points.select("fig").distinct().where("fig < 35").selectExpr(*_columns(f"SELECT {_AXES} FROM x"))
    axes = axes.withColumn("high", F.when(F.col("high") > 0, F.col("high")))
    return recalibrated(points, axes).select("id", "value", "method", "sure")


_FITS = "fig, CAST(40 AS DOUBLE) AS x0, CAST(20 AS DOUBLE) AS y0, CAST(440 AS DOUBLE) AS x1, CAST(320 AS DOUBLE) AS y1, CASE WHEN fig % 3 = 0 THEN NULL ELSE CAST(fig AS DOUBLE) / 100 END AS x_a, CAST(2 AS DOUBLE) AS x_b, 'linear' AS x_scale, CASE WHEN fig % 4 = 0 THEN NULL ELSE CAST(-1 AS DOUBLE) / 100 END AS y_a, CAST(3 AS DOUBLE) AS y_b, CASE WHEN fig % 2 = 0 THEN 'log10' ELSE 'linear' END AS y_scale, CASE WHEN fig % 5 = 0 THEN CAST(1 AS DOUBLE) / 2 END AS y2_a, CAST(7 AS DOUBLE) AS y2_b, 'linear' AS y2_scale"


@BOOK.add(f"""WITH q AS (SELECT event_id AS id, user_id % 40 AS fig, CAST(event_id % 480 AS DOUBLE) AS px, CAST(event_id % 350 AS DOUBLE) AS py FROM events), f AS (SELECT {_FITS} FROM (SELECT DISTINCT fig FROM q)), j AS (SELECT * FROM q JOIN f USING (fig))
SELECT id, round(coalesce(x_a * px + x_b, (px - x0) / (x1 - x0)), 5) AS x, round(coalesce(CASE y_scale WHEN 'log10' THEN pow(10, y_a * py + y_b) ELSE y_a * py + y_b END, 1 - (py - y0) / (y1 - y0)), 5) AS y, CASE WHEN px >= 240 THEN round(y2_a * py + y2_b, 5) END AS y_right,
CASE WHEN x_a IS NULL THEN 'normalized' ELSE x_scale END AS x_type, CASE WHEN y_a IS NULL THEN 'normalized' ELSE y_scale END AS y_type, CASE WHEN x_a IS NULL AND y_a IS NULL THEN 'normalized_fallback' ELSE 'ocr_ticks' END AS method FROM j""")
def cht5_pixels_to_values(spark, sf_dir):
    pixels = table(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id % 40 AS fig", "CAST(event_id % 480 AS DOUBLE) AS px", "CAST(event_id % 350 AS DOUBLE) AS py")
    return pixels_to_values(pixels, pixels.select("fig").distinct().selectExpr(*_columns(f"SELECT {_FITS} FROM x"))).drop("fig", "px", "py")


@BOOK.add("""WITH t AS (SELECT l_suppkey AS fig, CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE 'y' END AS axis, l_quantity AS px, l_extendedprice - 2000 AS value, CASE WHEN l_suppkey % 2 = 0 THEN 'log10' ELSE 'linear' END AS scale FROM lineitem),
g AS (SELECT fig, axis, count(*) AS n, min(value) AS t0, max(value) AS t1, count(*) FILTER (scale <> 'log10' OR value > 0) AS used, corr(CASE WHEN scale <> 'log10' OR value > 0 THEN px END, CASE WHEN scale <> 'log10' THEN value WHEN value > 0 THEN log10(value) END) AS r FROM t GROUP BY fig, axis),
s AS (SELECT s_suppkey AS fig, unnest(['x','y','y2']) AS axis, 0.0::DOUBLE AS low, 50000.0::DOUBLE AS high FROM supplier), k AS (SELECT s.*, n, used, r, round(CASE WHEN n >= 2 AND greatest(high, t1) - least(low, t0) > 0 THEN (least(high, t1) - greatest(low, t0)) / (greatest(high, t1) - least(low, t0)) ELSE 0.5 END, 3) AS score FROM s LEFT JOIN g USING (fig, axis))
SELECT fig, axis, score, coalesce(n, 0) AS ticks, round(coalesce(CASE WHEN used >= 3 AND NOT isnan(r) THEN greatest(0, least(1, r * r)) END, 0), 6) AS r2, score > 0.5 AS ok FROM k""")
def cht6_axis_checks(spark, sf_dir):
    """Stated ranges of axes against their ticks, with the squared correlation of pixels and values (MATH-5)."""
    ticks = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS fig", "CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE 'y' END AS axis", "l_quantity AS px", "l_extendedprice - 2000 AS value", "CASE WHEN l_suppkey % 2 = 0 THEN 'log10' ELSE 'linear' END AS scale")
    stated = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fig"), F.explode(F.array(F.lit("x"), F.lit("y"), F.lit("y2"))).alias("axis"), F.lit(0.0).alias("low"), F.lit(50000.0).alias("high"))
    return axis_checks(stated, ticks).withColumn("r2", F.round("r2", 6))


_METHODS = "p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'mineru_chart_table' WHEN 1 THEN 'known_log_axis' WHEN 2 THEN 'ocr_ticks' ELSE NULL END AS method, CASE p_partkey % 4 WHEN 0 THEN 'rheology_flow_curve' WHEN 1 THEN 'multi_panel_composite' ELSE 'bar_chart' END AS image_type, CASE WHEN p_partkey % 8 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) / 100 END AS axis_confidence, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(1 AS DOUBLE) / 2 END AS confidence"


@BOOK.add(f"""SELECT id, CASE WHEN method = 'mineru_chart_table' THEN 0.86::DOUBLE WHEN image_type = 'multi_panel_composite' THEN 0.9 WHEN image_type = 'rheology_flow_curve' THEN coalesce(nullif(axis_confidence, 0), 0.62) WHEN method = 'known_log_axis' THEN 0.9 WHEN method = 'ocr_ticks' THEN 0.72 ELSE coalesce(confidence, 0.35) END AS sure,
CASE WHEN method = 'mineru_chart_table' THEN 'mineru_chart_table_bound' ELSE 'standard' END AS data_quality FROM (SELECT {_METHODS} FROM part)""")
def cht7_quality_notes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr(*_columns(f"SELECT {_METHODS} FROM part"))
    return quality_notes(rows).select("id", "sure", "data_quality")


@BOOK.add(f"""WITH {cte('p', POINTS)}, t AS (SELECT *, CASE family WHEN 'data_chart' THEN [CASE WHEN x IS NULL THEN 'missing_x_value' END, CASE WHEN y IS NULL AND coalesce(band_intensity, 0) = 0 THEN 'missing_y_value' END, CASE WHEN x_unit = '' AND x_label = '' THEN 'missing_x_axis_label' END, CASE WHEN y_unit = '' AND y_label = '' THEN 'missing_y_axis_label' END, CASE WHEN x_axis_type IN ('pixel','normalized') THEN 'normalized_axis_only' END]
WHEN 'microscopy' THEN [CASE WHEN pixel_size IS NULL THEN 'no_scale_bar_calibration' END, CASE WHEN object_count = 0 AND description = '' THEN 'no_objects_detected' END, CASE WHEN object_count > 200 THEN 'high_object_count_needs_review' END, CASE WHEN channel = '' THEN 'channel_not_detected' END, CASE WHEN coalesce(diameter, 0) = 0 AND pixel_size IS NOT NULL THEN 'object_diameter_not_computed' END, CASE WHEN object_class = '' THEN 'object_class_unverified' END]
WHEN 'protein_assay' THEN [CASE WHEN band_intensity IS NULL AND qualitative = '' THEN 'missing_band_intensity' END, CASE WHEN molecular_weight IS NULL THEN 'molecular_weight_not_detected' END, CASE WHEN target_protein = '' THEN 'target_protein_not_identified' END, CASE WHEN loading_control = '' THEN 'no_loading_control_detected' END]
ELSE ['non_data_visual_descriptive', CASE WHEN description = '' AND qualitative = '' THEN 'empty_description' END] END AS every FROM p),
w(tag, f) AS (VALUES ('missing_x_value', 0.5::DOUBLE), ('missing_y_value', 0.5), ('missing_x_axis_label', 0.8), ('missing_y_axis_label', 0.8), ('normalized_axis_only', 0.85), ('no_scale_bar_calibration', 0.6), ('no_objects_detected', 0.4), ('high_object_count_needs_review', 0.7), ('channel_not_detected', 0.9), ('object_diameter_not_computed', 0.8), ('object_class_unverified', 0.8), ('missing_band_intensity', 0.5), ('molecular_weight_not_detected', 0.85), ('target_protein_not_identified', 0.8), ('no_loading_control_detected', 0.9)),
l AS (SELECT *, list_filter(every, lambda x: x IS NOT NULL) AS tags FROM t), m AS (SELECT id, coalesce(product(f), 1) AS factor FROM (SELECT id, unnest(tags) AS tag FROM l) LEFT JOIN w USING (tag) GROUP BY id),
s AS (SELECT l.id, tags, CASE WHEN family = 'non_data_visual' THEN CASE WHEN len(tags) > 1 THEN 0.1::DOUBLE ELSE greatest(0.3::DOUBLE, confidence * 0.8::DOUBLE) END ELSE least(1, greatest(0.1::DOUBLE, greatest(0.5::DOUBLE, confidence * 1.2::DOUBLE) * coalesce(factor, 1))) END AS sure FROM l LEFT JOIN m USING (id))
SELECT id, round(sure, 3) AS sure, array_to_string(tags, ';') AS tags, sure < 0.4 - 1e-12 OR list_contains(tags, 'no_scale_bar_calibration') OR list_contains(tags, 'missing_x_value') AS needs_review FROM s""")
def cht8_point_families(spark, sf_dir):
    """Quality of points by the rules of each of four families (also UDF-5)."""
    out = point_quality(derived.rows(spark, sf_dir, POINTS))
    return out.select("id", "sure", F.array_join("tags", ";").alias("tags"), "needs_review")


@BOOK.add("""WITH p AS (SELECT user_id % 40 AS fig, CAST(event_id * 7 % 400 AS DOUBLE) AS px, CAST(event_id * 13 % 300 AS DOUBLE) AS py FROM events WHERE event_type = 'purchase'), m AS (SELECT user_id % 40 AS fig, event_id AS marker, CAST(event_id * 11 % 400 AS DOUBLE) AS px, CAST(event_id * 17 % 300 AS DOUBLE) AS py, event_id % 90 AS area, CASE WHEN event_id % 6 = 0 THEN 'gray' ELSE 'red' END AS colour FROM events WHERE event_type <> 'purchase')
SELECT fig, marker FROM m WHERE colour <> 'gray' AND area >= 35 AND NOT EXISTS (SELECT 1 FROM p WHERE p.fig = m.fig AND abs(p.px - m.px) < 6 AND abs(p.py - m.py) < 6)""")
def cht9_merged_markers(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    points = events.where("event_type = 'purchase'").selectExpr("user_id % 40 AS fig", "CAST(event_id * 7 % 400 AS DOUBLE) AS px", "CAST(event_id * 13 % 300 AS DOUBLE) AS py")
    markers = events.where("event_type <> 'purchase'").selectExpr("user_id % 40 AS fig", "event_id AS marker", "CAST(event_id * 11 % 400 AS DOUBLE) AS px", "CAST(event_id * 17 % 300 AS DOUBLE) AS py", "event_id % 90 AS area", "CASE WHEN event_id % 6 = 0 THEN 'gray' ELSE 'red' END AS colour")
    return merged_markers(points, markers)


@BOOK.add("""WITH RECURSIVE p AS (SELECT user_id % 40 AS fig, CAST(event_id * 7 % 400 AS DOUBLE) AS px, CAST(event_id * 13 % 300 AS DOUBLE) AS py FROM events WHERE event_type = 'purchase'),
m AS (SELECT user_id % 40 AS fig, event_id AS marker, CAST(event_id * 11 % 200 AS DOUBLE) / 2 AS px, CAST(event_id * 17 % 150 AS DOUBLE) / 2 AS py, event_id % 90 AS area, CASE WHEN event_id % 6 = 0 THEN 'gray' ELSE 'red' END AS colour FROM events WHERE event_type <> 'purchase'),
f AS (SELECT *, row_number() OVER (PARTITION BY fig ORDER BY marker) AS k FROM m WHERE colour <> 'gray' AND area >= 35 AND NOT EXISTS (SELECT 1 FROM p WHERE p.fig = m.fig AND abs(p.px - m.px) < 6 AND abs(p.py - m.py) < 6)),
g AS (SELECT fig, k, [{'marker': marker, 'px': px, 'py': py}] AS kept FROM f WHERE k = 1
  UNION ALL SELECT f.fig, f.k, CASE WHEN len(list_filter(kept, lambda q: abs(q.px - f.px) < 6 AND abs(q.py - f.py) < 6)) > 0 THEN kept ELSE list_append(kept, {'marker': marker, 'px': px, 'py': py}) END FROM g JOIN f ON f.fig = g.fig AND f.k = g.k + 1)
SELECT fig, unnest(list_transform(kept, lambda q: q.marker)) AS marker FROM g WHERE k = (SELECT max(k) FROM f WHERE f.fig = g.fig)""")
def cht9_suppressed_markers(spark, sf_dir):
    """Markers on crowded figures, taken one after the other; the SQL walks through each figure in order."""
    events = table(spark, sf_dir, "events")
    points = events.where("event_type = 'purchase'").selectExpr("user_id % 40 AS fig", "CAST(event_id * 7 % 400 AS DOUBLE) AS px", "CAST(event_id * 13 % 300 AS DOUBLE) AS py")
    markers = events.where("event_type <> 'purchase'").selectExpr("user_id % 40 AS fig", "event_id AS marker", "CAST(event_id * 11 % 200 AS DOUBLE) / 2 AS px", "CAST(event_id * 17 % 150 AS DOUBLE) / 2 AS py", "event_id % 90 AS area", "CASE WHEN event_id % 6 = 0 THEN 'gray' ELSE 'red' END AS colour")
    return suppressed_markers(points, markers)


_CAPTIONS = "p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'Cells (A, B) under DAPI. Scale bar 10 um' WHEN 1 THEN 'GFP and RFP (a;c) (D)' WHEN 2 THEN 'Overview (see text)' ELSE NULL END AS caption, CASE WHEN p_partkey % 3 = 0 THEN CAST(10 AS DOUBLE) END AS scale_bar, CASE p_partkey % 4 WHEN 0 THEN 'DAPI' WHEN 1 THEN 'gfp' ELSE '' END AS channel, CAST(p_partkey % 4 AS INTEGER) AS panel_count"


@BOOK.add(f"""WITH c AS (SELECT {_CAPTIONS} FROM part), k AS (SELECT *, CASE WHEN starts_with(caption, 'Cells') THEN ['A','B'] WHEN starts_with(caption, 'GFP') THEN ['A','C','D'] ELSE [] END AS panels FROM c), w AS (SELECT id, array_to_string(panels, '') AS panels, array_to_string(list_filter([
CASE WHEN starts_with(caption, 'Cells') AND scale_bar IS NULL THEN 'caption_mentions_scale_bar_but_no_scale_bar_detected' END,
CASE WHEN starts_with(caption, 'Cells') AND channel <> 'DAPI' THEN 'caption_mentions_channels_dapi_but_channel_is_' || coalesce(nullif(lower(channel), ''), 'not_set') WHEN starts_with(caption, 'GFP') AND channel <> 'gfp' THEN 'caption_mentions_channels_gfp,rfp_but_channel_is_' || coalesce(nullif(lower(channel), ''), 'not_set') END,
CASE WHEN len(panels) > 0 AND panel_count < len(panels) THEN 'caption_has_' || len(panels) || '_panel_labels_but_only_' || panel_count || '_extracted' END], lambda x: x IS NOT NULL), ';') AS warnings FROM k)
SELECT id, panels, warnings, warnings <> '' AS needs_review FROM w""")
def cht11_caption_check(spark, sf_dir):
    """Panel letters of captions (STR-29) and what they say against what was extracted."""
    rows = table(spark, sf_dir, "part").selectExpr(*_columns(f"SELECT {_CAPTIONS} FROM part")).withColumn("panels", panel_labels(F.col("caption")))
    return caption_warnings(rows).select("id", F.array_join("panels", "").alias("panels"), "warnings", "needs_review")


@BOOK.add(f"WITH c AS (SELECT {_CAPTIONS} FROM part) SELECT id, CASE WHEN starts_with(caption, 'Cells') THEN 'AB' WHEN starts_with(caption, 'GFP') THEN 'ACD' ELSE '' END AS panels FROM c")
def str29_panel_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr(*_columns(f"SELECT {_CAPTIONS} FROM part"))
    return rows.select("id", F.array_join(panel_labels(F.col("caption")), "").alias("panels"))


@BOOK.add("""SELECT l_suppkey AS fig, round(greatest(0, least(1, coalesce(corr(l_quantity, log10(l_extendedprice)) ** 2, 0))), 6) AS r2 FROM lineitem WHERE l_extendedprice > 0 GROUP BY l_suppkey HAVING count(*) >= 3""")
def math5_r_squared(spark, sf_dir):
    """Squared correlation of pixels and the logarithms of positive values, within 0 and 1."""
    ticks = table(spark, sf_dir, "lineitem").where("l_extendedprice > 0").selectExpr("l_suppkey AS fig", "'x' AS axis", "l_quantity AS px", "l_extendedprice AS value", "'log10' AS scale")
    stated = ticks.select("fig", "axis", F.lit(0.0).alias("low"), F.lit(1.0).alias("high")).distinct()
    return axis_checks(stated, ticks).where("ticks >= 3").select("fig", F.round("r2", 6).alias("r2"))


@BOOK.add("""SELECT p_partkey AS id, round(50 + (CASE WHEN p_size % 2 = 0 AND p_retailprice > 0 THEN (log10(p_retailprice) - log10(10)) / (log10(10000) - log10(10)) ELSE (p_retailprice - 10) / 9990 END) * 400, 5) AS px FROM part""")
def math7_value_to_pixel(spark, sf_dir):
    scale = F.when(F.col("p_size") % 2 == 0, "log10").otherwise("linear")
    pixel = to_pixel(F.col("p_retailprice"), F.lit(10.0), F.lit(10_000.0), F.lit(50.0), F.lit(400.0), scale)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(pixel, 5).alias("px"))


@BOOK.add("""WITH RECURSIVE t AS (SELECT fig, px, value, row_number() OVER (PARTITION BY fig ORDER BY px, value) AS rn FROM (SELECT DISTINCT p_brand AS fig, (p_size * 37 % 900)::DOUBLE AS px, (p_size * 11 % 60 - 30)::DOUBLE AS value FROM part)),
k AS (SELECT fig, rn, px, value, 1 AS g FROM t WHERE rn = 1 UNION ALL SELECT t.fig, t.rn, CASE WHEN abs(k.px - t.px) < 8 AND abs(t.value) <= abs(k.value) THEN k.px ELSE t.px END, CASE WHEN abs(k.px - t.px) < 8 AND abs(t.value) <= abs(k.value) THEN k.value ELSE t.value END, CASE WHEN abs(k.px - t.px) < 8 THEN g ELSE g + 1 END FROM k JOIN t ON t.fig = k.fig AND t.rn = k.rn + 1)
SELECT fig, arg_max(px, rn) AS px, arg_max(value, rn) AS value FROM k GROUP BY fig, g""")
def win12_distinct_ticks(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_brand AS fig", "CAST(p_size * 37 % 900 AS DOUBLE) AS px", "CAST(p_size * 11 % 60 - 30 AS DOUBLE) AS value").distinct()
    ticks = rows.groupBy("fig").agg(F.collect_list(F.struct("px", "value")).alias("ticks"))  # the ticks of one axis
    return ticks.select("fig", F.inline(distinct_ticks("ticks")))


@BOOK.add("""WITH RECURSIVE t AS (SELECT fig, y0, x0, row_number() OVER (PARTITION BY fig ORDER BY y0, x0) AS rn FROM (SELECT DISTINCT p_brand AS fig, (p_size * 37 % 900)::DOUBLE AS y0, (p_size * 13 % 200)::DOUBLE AS x0 FROM part)),
k AS (SELECT fig, rn, y0, y0 + 10 AS y1, x0, x0 + 30 AS x1, 1 AS g FROM t WHERE rn = 1 UNION ALL SELECT t.fig, t.rn, CASE WHEN abs(k.y0 - t.y0) < 8 THEN least(k.y0, t.y0) ELSE t.y0 END, CASE WHEN abs(k.y0 - t.y0) < 8 THEN greatest(k.y1, t.y0 + 10) ELSE t.y0 + 10 END,
CASE WHEN abs(k.y0 - t.y0) < 8 THEN least(k.x0, t.x0) ELSE t.x0 END, CASE WHEN abs(k.y0 - t.y0) < 8 THEN greatest(k.x1, t.x0 + 30) ELSE t.x0 + 30 END, CASE WHEN abs(k.y0 - t.y0) < 8 THEN g ELSE g + 1 END FROM k JOIN t ON t.fig = k.fig AND t.rn = k.rn + 1)
SELECT fig, arg_max(y0, rn) AS y0, arg_max(x0, rn) AS x0, arg_max(y1, rn) AS y1, arg_max(x1, rn) AS x1 FROM k GROUP BY fig, g""")
def arr12_line_boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_brand AS fig", "CAST(p_size * 37 % 900 AS DOUBLE) AS y0", "CAST(p_size * 13 % 200 AS DOUBLE) AS x0").distinct()
    boxes = rows.groupBy("fig").agg(F.collect_list(F.struct("y0", "x0", (F.col("y0") + 10).alias("y1"), (F.col("x0") + 30).alias("x1"))).alias("boxes"))  # those of one page
    return boxes.select("fig", F.inline(line_boxes("boxes")))


@BOOK.add(f"WITH {cte('p', POINTS)} SELECT family, count(*) AS n FROM p GROUP BY family")
def udf5_families(spark, sf_dir):
    """How many points each family's rules were applied to; every point gets a score within 0 and 1."""
    scored = point_quality(derived.rows(spark, sf_dir, POINTS))
    return scored.where("sure between 0 and 1").groupBy("family").agg(F.count("*").alias("n"))
