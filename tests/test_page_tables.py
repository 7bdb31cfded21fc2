"""Blocks and verdicts of tables on small pages, one case for each rule and each way out."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import page_tables as op


def blocks(spark, *texts):
    lines = op.page_lines(spark.createDataFrame([(1, k + 2, t) for k, t in enumerate(texts)], "doc_id int, page int, text string"))
    return [(r.page, r.label, r.content) for r in op.captioned_blocks(lines).orderBy("page", "at").collect()]


def test_block_passes_over_blank_lines_and_ends_at_a_label(spark):
    """Blank lines are no lines; the line right below a caption never ends its block; a figure's or table's label further on does."""
    text = "intro\n\nTable  1 Sizes\n\n a 1 \n\nb 2\nsee Fig. 3 for more\nc 3"
    assert blocks(spark, text) == [(2, "Table 1", "Table  1 Sizes\na 1\nb 2")]
    assert blocks(spark, "Table 2. A\nTable 3. B\nx 1") == [(2, "Table 2", "Table 2. A\nTable 3. B\nx 1"), (2, "Table 3", "Table 3. B\nx 1")]


def test_block_has_twelve_lines_and_1600_characters(spark):
    assert blocks(spark, "Table IV\n" + "\n".join(f"row {i}" for i in range(30))) == [(2, "Table IV", "Table IV\n" + "\n".join(f"row {i}" for i in range(11)))]
    (found,) = blocks(spark, "表 5a 数据\n" + "x" * 5_000)
    assert found[1] == "表 5a" and len(found[2]) == 1600


@pytest.mark.parametrize(("line", "label"), [
    ("Table 1 Sizes", "Table 1"), ("supplementary   TABLE 2b: x", "supplementary TABLE 2b"), ("(see) Table 3", "Table 3"), ("1234567 Table 4", "Table 4"), ("12345678 Table 4", None), ("123456789 Table 4", None),
    ("Table 1) x", None), ("Table 1, x", None), ("Table 1 ; x", None), ("Table 1] x", None), ("Table 1 and 2", None), ("Table 1 In all", None), ("Table 1 forward", "Table 1"), ("stable 1 x", None), ("Table 1b2 x", None), ("Table x", "Table x"), ("", None),
])
def test_caption_lines(spark, line, label):
    assert spark.createDataFrame([(line,)], "s string").select(op.caption_label(F.col("s"))).first()[0] == label


def test_equal_blocks_of_a_page_are_one(spark):
    text = "Table 1 x\na\nb\nFigure 2\ntable 1 x\nTable 1 x\na\nb\nFigure 9"
    assert [b[1] for b in blocks(spark, text)] == ["Table 1", "table 1"]


def steady(spark, text, page=2):
    lines = op.page_lines(spark.createDataFrame([(1, page, text)], "doc_id int, page int, text string"))
    return [r.content for r in op.steady_blocks(lines).orderBy("at").collect()]


GOOD = "a  1\nb  2\nc  3"


def test_steady_runs(spark):
    assert steady(spark, GOOD) == [GOOD]
    assert steady(spark, "x\n" + GOOD.replace("  ", "\t") + "\ny\n" + GOOD.replace("  ", " | ")) == [GOOD.replace("  ", "\t"), GOOD.replace("  ", " | ")]
    assert steady(spark, "a  1\nb  2") == []  # two lines
    assert steady(spark, "a  1\n\nb  2\n\n\nc  3") == [GOOD]  # blank lines do not part
    for parted in ("plain words", "Received: May", "Table 4 x  y", "Fig. 2  y"):
        assert steady(spark, f"a  1\nb  2\n{parted}\nc  3\nd  4") == []
    assert steady(spark, "a  b\nc  d\ne  1") == []  # one line with a number
    assert steady(spark, GOOD + "\nd  4  5") == [GOOD + "\nd  4  5"]  # three quarters of one width
    assert steady(spark, "a  1\nb  2\nc  3\nd  4  5\ne  6  7") == []
    assert steady(spark, "\n".join(f"r{i}  {i}" for i in range(5_000))) == ["\n".join(f"r{i}  {i}" for i in range(12))]
    assert steady(spark, GOOD + "\nx\n" + GOOD) == [GOOD]


def test_first_page_needs_a_caption(spark):
    assert steady(spark, GOOD, page=1) == []
    assert steady(spark, "Table 1 x\n" + GOOD, page=1) == [GOOD]
    assert steady(spark, "Table 1 x doi\n" + GOOD, page=1) == []  # a caption in front matter does not count


def test_ten_tables_of_a_document_and_captions_first(spark):
    pages = [(1, k, f"Table {k} x\n{GOOD}") for k in range(1, 15)] + [(2, 2, GOOD), (2, 1, "x"), (3, 1, None)]
    pages = spark.createDataFrame(pages, "doc_id int, page int, text string")
    rows = op.page_tables(pages).orderBy("doc", "place").collect()
    assert [(r.doc, r.place, r.page, r.label, r.source) for r in rows] == [(1, k, k, f"Table {k}", "fallback_candidate") for k in range(1, 11)] + [(2, 1, 2, "Detected Table-like Block 1", "weak_table_candidate")]
    assert {tuple(r) for r in op.table_reports(pages).collect()} == {(1, "fallback", 10), (2, "partial", 1), (3, "failed", 0)}


WORDS = "some longer running words"
CASES = [
    ("rows", None, 2, ""), ("rows", [], 2, ""), ("rows", [["a", "1"], ["b", "2"]], 2, "Table 1 x"), ("rows", [["a", "1"], ["b", "2"], [" ", None], None], 2, ""),
    ("width", [["a"], ["b", "2"], ["c"]], 2, ""), ("width", [["a", ""], ["b", " "], ["c"]], 2, ""),
    ("ragged", [["a", "1"], ["b", "2"], ["1", "2", "3", "4"], ["1", "2", "3", "4", "5"], ["1"] * 7], 2, ""),
    ("metadata", [["doi", "1"], ["www.x", "2"], ["c", "3"]], 2, "Table 1 x"), ("metadata", [["Nature Communications", "1"], ["b", "2"], ["c", "3"]], 2, "Table 1 x"),
    ("scaffold", [["Figure 2", "1"], ["b", "2"], ["c", "3"]], 2, "Table 1 x"), ("scaffold", [["article", "1"], ["b www.", "2"], ["c", "3"]], 2, "Table 1 x"),
    ("front_page", [["a", "1"], ["b", "2"], ["c", "3"]], 1, "received: accepted: doi abstract"), ("accepted", [["a", "1"], ["b", "2"], ["c", "3"]], 2, "received: accepted: doi abstract"),
    ("broken", [["ab-\ncd", "1"], ["b\nc\nd", "x\n\ny"], ["c", "3"]], 2, "Table 1 x"),
    ("references", [["1.", "x"], [" 22. ", "y"], ["c", "3"]], 2, ""), ("references", [["Smith et al", "1"], ["Journal", "2"], ["c", "3"]], 2, ""), ("accepted", [["1.", "x"], ["22.", "y"], ["c", "3"]], 2, "Table 1 x"),
    ("fragments", [["a", "b"], ["c", "d"], ["e", "f"], ["g", "5"]], 2, ""), ("accepted", [["a", "b"], ["c", "d"], ["e", "f"]], 2, "Table 1 x"),
    ("accepted", [["a", "1"], ["b", "2"], ["c", "3", "4"]], 2, "Table 1 x"),
    ("unsteady", [["1"] * 2, ["1"] * 2, ["1"] * 3, ["1"] * 5, ["1"] * 6], 2, "Table 1 x"),
    ("first_page", [["a", "1"], ["b", "2"], ["c", "3"], ["d", "4", "5"]], 1, ""), ("accepted", [["a", "1"], ["b", "2"], ["c", "3"], ["d", "4", "5"]], 2, ""),
    ("not_numeric", [[WORDS, WORDS], [WORDS, WORDS], [WORDS, WORDS + " 1"]], 2, ""), ("accepted", [[WORDS, WORDS], [WORDS, "3 " + WORDS], [WORDS, WORDS + " 1"]], 2, ""),
    ("not_numeric", [["a", "1"], ["b", "2"], ["c", "3"], ["1"] * 4], 2, ""),
]


@pytest.mark.parametrize(("want", "rows", "page", "body"), CASES)
def test_verdicts(spark, want, rows, page, body):
    found = spark.createDataFrame([(rows, page, body)], "rows array<array<string>>, page int, body string")
    found = found.withColumns({"captioned": op.page_captioned(F.col("body")), "front_terms": op.terms_in(F.col("body"), op.METADATA_TERMS)})
    assert op.table_verdicts(found).first()["verdict"] == want

