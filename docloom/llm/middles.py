"""Operator 13, fill-in-middle transformation by relational units.

A text is a sequence of units (runs of letters and single other characters). Two cut requests a document name the unit
ordinals at which its prefix and its middle end. Matches are exploded with their positions, window sums number them and
add up their lengths, requests are joined by ordinal, and what they meet is aggregated to two character offsets a document,
at which ``substring`` takes the text apart. This is done on two levels: first on pieces of whole units, over all of the
text, then on the units of the pieces that a request falls into, so no array and no window is longer than a piece's units.

Texts are shuffled once: all that follows (pieces, requests, offsets, texts) is keyed by one digest of id and text and
stays in its partition. Texts that stay as they are (empty, with a sentinel, or left plain by chance) never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the transformation: units, sentinels, shares in a hundred.
UNIT, PREFIX, SUFFIX, MIDDLE = "[A-Za-z]+|[^A-Za-z]", "<P>", "<S>", "<M>"
PLAIN_SHARE, SPM_SHARE = 10, 20
#: Characters of a piece before it is carried on to the end of its last unit.
PIECE_CHARS = 256
PIECE = f"(?s).{{1,{PIECE_CHARS}}}[A-Za-z]*"


def _draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers below 2^32 that depend on the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def requests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """(id, text, n, form, first, second): units and form of each text and the ordinals after which it is cut."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h1, h2, h3, h4 = _draws("id", seed)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.withColumn("n", F.length(F.regexp_replace("text", "[A-Za-z]+", "a")).cast("long"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= 100 - plain_share)
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    return rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")).withColumns(
        {"first": F.least(one, two), "second": F.greatest(one, two)}
    )


def pieces(texts: DataFrame) -> DataFrame:
    """(key, part, units, units_before, chars_before) of ``texts`` (key, text): runs of whole units with the sums of all before them."""
    parts = texts.select("key", F.posexplode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).alias("piece", "part"))
    parts = parts.withColumn("units", F.length(F.regexp_replace("part", "[A-Za-z]+", "a")).cast("long"))
    ahead = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {"units_before": F.sum("units").over(ahead) - F.col("units"), "chars_before": F.sum(F.length("part")).over(ahead) - F.length("part")}
    return parts.withColumns(sums).select("key", "part", "units", *sums)


def offsets(texts: DataFrame, cuts: DataFrame) -> DataFrame:
    """(key, cut, chars): for each of ``cuts`` (key, cut, ordinal) the characters of ``texts`` (key, text) up to the end of that unit.

    The piece that holds a cut is found by the sums over all pieces, its units by the running sums within it. Both joins
    are merge joins: their sides are in place, and Spark's guess of an exploded side's size is far too low to broadcast it.
    """
    held = (F.col("ordinal") > F.col("units_before")) & (F.col("ordinal") <= F.col("units_before") + F.col("units"))
    met = pieces(texts).join(cuts.hint("merge"), "key").where(held)
    met = met.select("key", "cut", (F.col("ordinal") - F.col("units_before")).alias("wanted"), "chars_before", F.posexplode(F.regexp_extract_all("part", F.lit(UNIT), F.lit(0))).alias("at", "unit"))
    lengths = met.select("key", "cut", "wanted", "chars_before", "at", F.length("unit").alias("chars"))
    ahead = Window.partitionBy("key", "cut").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = lengths.select("key", "cut", "wanted", F.row_number().over(ahead).alias("ordinal"), (F.col("chars_before") + F.sum("chars").over(ahead)).alias("chars"))
    return sums.where("ordinal = wanted").select("key", "cut", "chars")


def _output() -> Column:
    prefix, suffix = F.expr("substring(text, 1, cast(cut_one as int))"), F.expr("substring(text, cast(cut_two as int) + 1)")
    middle = F.expr("substring(text, cast(cut_one as int) + 1, cast(cut_two - cut_one as int))")
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``; ``options`` as of ``requests``.

    Null texts count as empty ones and stay plain, as do texts that hold a sentinel. Rows with null or repeated ids are
    separate rows: draws depend on the id alone (null: the empty string), equal rows give equal rows. An empty table gives
    no rows. Very long texts become many pieces of about ``PIECE_CHARS`` characters; a run of letters longer than
    that is one unit of one piece. Other columns, whatever their names, are ignored.
    """
    rows = requests(docs, id_col, text_col, **options)
    plain = rows.where("form = 'plain'").withColumns({c: F.lit(None).cast("long") for c in ("cut_one", "cut_two")})

    moved = rows.where("form <> 'plain'")
    named = F.concat(F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")), F.lit("\n"), "text")
    key = F.coalesce(F.unhex(F.substring(F.sha2(named, 256), 1, 32)), F.lit(b""))  # never null, so that no reader filters it
    # Equal rows are one from here on, counted before they move, so that a hot row is no hot key.
    whole = F.any_value(F.struct("id", "text", "n", "form", "first", "second")).alias("doc")
    texts = moved.groupBy(key.alias("key")).agg(whole, F.count("*").alias("copies"))
    # Both readers of ``texts`` use the same columns (there are no rows without copies), so Spark shuffles the texts once.
    read = texts.where("copies > 0").select("key", "doc.text")
    asked = texts.select("key", "copies", "doc.*").where("copies > 0")
    both = F.explode(F.array(*(F.struct(F.lit(c).alias("cut"), F.col(c).alias("ordinal")) for c in ("first", "second"))))
    found = offsets(read, asked.select("key", both.alias("request")).select("key", "request.*"))
    ends = found.groupBy("key").agg(*(F.max(F.when(F.col("cut") == c, F.col("chars"))).alias(name) for c, name in (("first", "cut_one"), ("second", "cut_two"))))
    # A cut before the first unit meets none and is at offset 0.
    placed = asked.join(ends.hint("merge"), "key", "left").na.fill(0, ["cut_one", "cut_two"])
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    columns = ["id", "text", "n", "form", "cut_one", "cut_two"]
    out = placed.select(*columns).union(plain.select(*columns))
    return out.select(
        F.col("id").alias(id_col), "n", "form", F.col("cut_one").alias("prefix_chars"), (F.col("cut_two") - F.col("cut_one")).alias("middle_chars"),
        _output().alias("output"),
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from the output and its form alone.

    No text in psm or spm form holds a sentinel, and none can arise where two parts meet, as each begins with ``<``, so
    the sentinels found are those that were put in.
    """
    body = F.expr(f"substring({output}, {len(PREFIX) + 1})")
    head = F.when(F.col(form) == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    rest = F.substring(body, F.length(head) + len(SUFFIX) + 1, F.length(body).cast("int"))
    second, middle = F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)
    return F.when(F.col(form) == "psm", F.concat(head, middle, second)).when(F.col(form) == "spm", F.concat(second, middle, head)).otherwise(F.col(output))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLE_SQL = {
    "op13_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
        CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
f AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f"""
}
