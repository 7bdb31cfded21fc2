"""What is made of one row is made where the row lies, and quicker patterns find what the plain ones find."""

import random

from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import page_tables


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def strings(n, letters, seed=5):
    r = random.Random(seed)
    return [("".join(r.choice(letters) for _ in range(r.randrange(14))),) for _ in range(n)]


def test_parts_of_pages_are_not_shuffled(spark):
    pages = spark.createDataFrame([(1, "a|b\nc\n\nd  e\nf"), (2, ""), (3, None)], "doc int, text string")
    got = page_tables.parts_of_pages(pages, 2, r"\s{2,}|\|")
    assert [tuple(r) for r in got.orderBy("doc", "part").collect()] == [(1, 0, [["a", "b"], ["c"]]), (1, 1, [[""], ["d", "e"]]), (1, 2, [["f"]]), (2, 0, [[""]])]
    assert exchanges(got) == 0
    assert exchanges(page_tables.flt19_table_verdicts(spark, "/root/testdata/sf0.001")) == 0


def test_patterns_find_what_plain_ones_find(spark):
    df = spark.createDataFrame(strings(6_000, " \n\t\r\x0b\x85\xa0  ab\U0001f600") + [(None,)], "s string")
    s = F.col("s")
    plain = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    assert df.where(~text.strip(s).eqNullSafe(plain)).count() == 0
    assert df.where(~text.collapse(s).eqNullSafe(F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), r"(?U)^\s+|\s+$", ""))).count() == 0
    old = r"(?iU)(\d|%|mg|g/l|g\s*l-?1|ml|mmol|mol|µm|μm|um|nm|cm|mm|h\b|day|days|°c|kpa|mpa)"
    few = spark.createDataFrame(strings(20_000, "mMgGlLoO /µμΜuncdDayhH°CKkKpa-_x٣%"), "s string")
    assert few.where(s.rlike(page_tables.VALUE_OR_UNIT) != s.rlike(old)).count() == 0
    words = spark.createDataFrame(strings(6_000, "aé%µ.°- ,;\n"), "s string")
    assert words.where(s.rlike(page_tables.FOUR_WORDS) != (F.size(F.regexp_extract_all(s, F.lit(r"(?U)[\w%µμ°.-]+"), F.lit(0))) > 3)).count() == 0
    labels = spark.createDataFrame(strings(20_000, "tTaAbBlLeEfFiIıİgG.1  表图"), "s string").unionByName(spark.createDataFrame([("fıg 3",), ("FİG. 4",), ("x TABLE 7",), ("stable 1",)], "s string"))
    assert labels.where(page_tables.has_figure_label(s) != s.rlike(page_tables.FIGURE_LABEL)).count() == 0
    assert labels.where(page_tables.has_table_label(s) != s.rlike(page_tables.TABLE_LABEL)).count() == 0


def test_lines_are_numbered_where_they_lie(spark):
    pages = spark.createDataFrame([(1, 1, "\n a\r\n\n\x0b b \nTable 1 c"), (1, 2, None), (None, 1, "d")], "doc_id int, page int, text string")
    lines = page_tables.page_lines(pages)
    assert [(r.doc, r.page, r.at, r.line, r.caption) for r in lines.orderBy("doc", "page", "at").collect()] == [(None, 1, 0, "d", None), (1, 1, 0, "a", None), (1, 1, 1, "b", None), (1, 1, 2, "Table 1 c", "Table 1")]
    assert exchanges(lines) == 0
