"""Rules of papers over whole texts: the texts of the documents with line ends, captions, headings, reference lists and ligatures put in.

Both engines derive the same texts by ``replace``; the SQL computes what the rules of ``functions.text`` and ``documents`` give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators.documents import section_rows
from docloom.operators.fragments import caption_candidates, caption_label
from docloom.operators.library import caption_blocks
from docloom.plans.book import Book, table

BOOK = Book()


def _replaced(*pairs: tuple[str, str]) -> str:
    out = "text"
    for old, new in pairs:
        out = f"replace({out}, {old}, {new})"
    return out


LINES = ("'. '", "'.' || chr(10)")
#: Captions at some line starts, mentions of figures elsewhere.
CAPTIONED = _replaced(LINES, ("chr(10) || 'Th'", "chr(10) || '  Fig. 7 Th'"), ("chr(10) || 'Er'", "chr(10) || 'TABLE 12b. er'"), ("chr(10) || 'An'", "chr(10) || 'see Figure 3 an'"), ("chr(10) || 'Le'", "chr(10) || 'Figure x le'"))
#: Words parted at line ends, and ligatures.
BROKEN = _replaced(LINES, ("' und '", "'-' || chr(10) || '  '"), ("' the '", "' - ' || chr(10)"), ("'fi'", "'ﬁ'"), ("'ff'", "'ﬀ'"), ("'an '", "'an- ' || chr(10)"))
#: A heading of a reference list, more than once in some texts.
CITED = _replaced(LINES, ("chr(10) || 'In'", "chr(10) || '  REFERENCES ' || chr(10) || '[1] In'"), ("chr(10) || 'Le'", "chr(10) || 'references le'"), ("chr(10) || 'Es'", "chr(10) || '参考文献' || chr(10) || 'Es'"))
#: Markdown headings of three levels.
HEADED = _replaced(LINES, ("chr(10) || 'An'", "chr(10) || '## An'"), ("chr(10) || 'Re'", "chr(10) || '# Re'"), ("chr(10) || 'La'", "chr(10) || '#### La'"), ("chr(10) || 'Es'", "chr(10) || '### Es'"), ("chr(10) || 'Th'", "chr(10) || chr(10) || 'Th'"))
#: Paragraphs with empty lines between them.
SPACED = _replaced(LINES, ("chr(10) || 'Th'", "chr(10) || '  ' || chr(10) || ' Th'"), ("chr(10) || 'E'", "chr(10) || chr(10) || chr(10) || 'E'"))


def _texts(spark, sf_dir, what: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{what} AS text")


@BOOK.add(rf"""SELECT doc_id, regexp_replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬀ', 'ff'), '([\p{{L}}\p{{M}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{M}}\p{{N}}_])', '\1\2', 'g') AS repaired FROM (SELECT doc_id, {BROKEN} AS text FROM documents)""")
def str8_repaired_texts(spark, sf_dir):
    return _texts(spark, sf_dir, BROKEN).select("doc_id", text.repair(F.col("text")).alias("repaired"))


@BOOK.add(rf"""WITH t AS (SELECT doc_id, {CITED} AS text FROM documents), h AS (SELECT *, string_split(text, chr(10)) AS l FROM t),
k AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(lower(l[i]), '^\s*(references|bibliography|参考文献)\s*$'))[1] AS at_ FROM h)
SELECT doc_id, CASE WHEN at_ IS NULL THEN text ELSE trim(array_to_string(l[1:at_ - 1], chr(10)), E' \n\t\r') END AS body, CASE WHEN at_ IS NOT NULL THEN nullif(trim(array_to_string(l[at_ + 1:], chr(10)), E' \n\t\r'), '') END AS refs FROM k""")
def str10_split_references(spark, sf_dir):
    """What stands before and after the first heading of a reference list."""
    rows = _texts(spark, sf_dir, CITED).select("doc_id", text.references(F.col("text")).alias("r"))
    return rows.select("doc_id", "r.body", "r.refs")


@BOOK.add(rf"""WITH t AS (SELECT doc_id, string_split({CAPTIONED}, chr(10)) AS l FROM documents), k AS (SELECT *, list_transform(l, lambda s: regexp_matches(trim(s), '(?i)^((fig\.|figure|table)\s+[0-9]+[\p{{L}}\p{{N}}_.:-]*\s+.+)$')) AS c FROM t)
SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT c[i]), lambda i: l[i]), chr(10)) AS body, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: c[i]), lambda i: trim(l[i])), '|') AS captions FROM k""")
def str11_split_captions(spark, sf_dir):
    """Caption lines taken out of whole texts."""
    rows = _texts(spark, sf_dir, CAPTIONED).select("doc_id", text.captions(F.col("text")).alias("c"))
    return rows.select("doc_id", "c.body", F.array_join("c.captions", "|").alias("captions"))


@BOOK.add(rf"""WITH RECURSIVE t AS (SELECT doc_id, {HEADED} AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS i FROM t),
h AS (SELECT *, regexp_matches(s, '^#{{1,6}}\s+\S') AS head FROM l), n AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM h),
b AS (SELECT doc_id, k, trim(string_agg(s, chr(10) ORDER BY i), E' \n\t\r') AS body FROM n GROUP BY doc_id, k),
g AS (SELECT doc_id, k, length(regexp_extract(s, '^(#+)', 1)) AS level, trim(regexp_replace(s, '^#+\s+', '')) AS title FROM n WHERE head),
w AS (SELECT doc_id, k, [title] AS stack FROM g WHERE k = 1 UNION ALL SELECT g.doc_id, g.k, list_append(stack[1:level - 1], title) FROM w JOIN g ON g.doc_id = w.doc_id AND g.k = w.k + 1),
p AS (SELECT DISTINCT doc_id FROM g), s AS (SELECT b.doc_id, b.k, coalesce(array_to_string(stack, ' > '), '') AS path, body FROM b JOIN p USING (doc_id) LEFT JOIN w ON w.doc_id = b.doc_id AND w.k = b.k WHERE body <> ''),
q AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(x, E' \n\t\r')), lambda x: x <> '')) AS body, unnest(range(len(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(x, E' \n\t\r')), lambda x: x <> '')))) AS k FROM t WHERE doc_id NOT IN (SELECT doc_id FROM p))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS pos, path, body FROM (SELECT * FROM s UNION ALL SELECT doc_id, k, '', body FROM q)""")
def win8_sections_of_texts(spark, sf_dir):
    """Sections of whole texts with the path of their headings; texts without any give their paragraphs (also DOC-4, SRC-3)."""
    return section_rows(_texts(spark, sf_dir, HEADED))


@BOOK.add(rf"""SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, '' AS path, unnest(l) AS body FROM (SELECT doc_id, list_filter(list_transform(string_split_regex({SPACED}, '\n\s*\n'), lambda x: trim(x, E' \n\t\r')), lambda x: x <> '') AS l FROM documents)""")
def doc4_paragraphs_of_texts(spark, sf_dir):
    """Whole texts without headings: each paragraph is a section."""
    return section_rows(_texts(spark, sf_dir, SPACED))


#: Captions with empty lines after some of them, and labels that return.
NUMBERED = _replaced(LINES, ("chr(10) || 'Th'", "chr(10) || ' Fig. 7: Th'"), ("chr(10) || 'Er'", "chr(10) || 'TABLE  12b. er'"), ("chr(10) || 'An'", "chr(10) || 'see Figure 3 an'"), ("chr(10) || 'Es'", "chr(10) || chr(10) || 'Es'"), ("chr(10) || 'Le'", "chr(10) || 'figure 7 | le'"))
NUMBERED_LINES = rf"""l AS (SELECT doc_id, i, s FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS s, unnest(range(len(string_split(t, chr(10))))) AS i FROM (SELECT doc_id, {NUMBERED} AS t FROM documents)))"""


def _lines(spark, sf_dir) -> DataFrame:
    return _texts(spark, sf_dir, NUMBERED).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "s"))


@BOOK.add(rf"""WITH {NUMBERED_LINES}, c AS (SELECT doc_id, i, regexp_extract(s, '(?i)^\s*(fig(?:ure)?|table)\.?\s*([0-9][\p{{L}}\p{{N}}_.-]*)', 1) AS kind, regexp_extract(s, '(?i)^\s*(fig(?:ure)?|table)\.?\s*([0-9][\p{{L}}\p{{N}}_.-]*)', 2) AS n FROM l)
SELECT doc_id, CAST(i AS INTEGER) AS i, CASE WHEN lower(kind) = 'table' THEN 'table' ELSE 'figure' END AS kind, CASE WHEN lower(kind) = 'table' THEN 'Table ' ELSE 'Figure ' END || regexp_replace(n, '[.-]+$', '') AS label FROM c WHERE kind <> ''""")
def str16_labels_of_lines(spark, sf_dir):
    """Kind and label of every caption line of all texts."""
    return _lines(spark, sf_dir).select("doc_id", "i", caption_label(F.col("s")).alias("c")).where("c is not null").select("doc_id", "i", "c.kind", "c.label")


@BOOK.add(rf"""WITH {NUMBERED_LINES}, m AS (SELECT *, regexp_matches(s, '(?i)^\s*(?:fig\.?|figure|table)\s*[0-9]+') AS head, trim(s) = '' AS blank FROM l),
k AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM m), b AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id, part ORDER BY i) AS blanks FROM k WHERE part > 0),
c AS (SELECT doc_id, part, trim(regexp_replace(string_agg(s, chr(10) ORDER BY i), '\s+', ' ', 'g')) AS caption FROM b WHERE blanks = 0 GROUP BY doc_id, part),
f AS (SELECT *, replace(lower(regexp_extract(caption, '(?i)^((?:fig\.?|figure|table)\s*[0-9]+)', 1)), ' ', '') AS label FROM c WHERE length(caption) BETWEEN 20 AND 1200)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS pos, caption FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY part) AS n FROM f) WHERE n = 1""")
def str33_captions_of_texts(spark, sf_dir):
    """Captions of whole texts, from a label to the next one or an empty line, the first of each label."""
    rows = _texts(spark, sf_dir, NUMBERED).select("doc_id", F.posexplode(caption_candidates(F.col("text"))).alias("pos", "caption"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@BOOK.add(rf"""WITH {NUMBERED_LINES}, k AS (SELECT doc_id, i % 3 AS page, i AS block, s, regexp_extract(s, '(?i)((?:fig\.?|figure|table)\s*[0-9]+)', 1) AS found FROM l),
r AS (SELECT *, instr(s, found) - 1 AS at_, substr(s, instr(s, found) + length(found)) AS after_, regexp_replace(regexp_replace(lower(found), '\s+', '', 'g'), '^fig\.?([0-9])', 'figure\1') AS key FROM k WHERE found <> ''),
q AS (SELECT *, (CASE WHEN at_ = 0 THEN 4.0 WHEN at_ <= 30 THEN 2.0 ELSE 0 END) + (CASE WHEN substr(after_, 1, 1) IN ('.', ':', '：', '|', '-') THEN 1.0 ELSE 0 END) + (CASE WHEN length(s) >= 35 THEN 1.0 ELSE 0 END) + (CASE WHEN at_ <= 40 THEN 0.5 ELSE 0 END) AS score FROM r
  WHERE length(trim(after_, ' ')) >= 15 AND at_ <= 50 AND substr(trim(after_, ' '), 1, 1) NOT IN (')', ']', ',', ';'))
SELECT doc_id AS doc, page, CASE key WHEN 'figure7' THEN 'Figure 7' WHEN 'table12' THEN 'Table 12' ELSE 'Fig. 3' END AS label, arg_max(block, (score, -block)) AS block FROM q WHERE key IN ('figure7', 'table12', 'figure3') GROUP BY doc_id, page, key""")
def join25_captions_of_lines(spark, sf_dir):
    """The line of a page that is the caption of each of three labels, over the lines of all texts."""
    blocks = _lines(spark, sf_dir).select(F.col("doc_id").alias("doc"), (F.col("i") % 3).cast("long").alias("page"), F.col("i").cast("long").alias("block"), F.col("s").alias("text"))
    labels = blocks.select("doc", "page").distinct().withColumn("label", F.explode(F.array(*map(F.lit, ("Figure 7", "Table 12", "Fig. 3")))))
    return caption_blocks(labels, blocks)
