"""Text expressions as Columns: tokens, terms, snippets, hashes, splits and labels. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters dropped from query terms, longest list of terms.
STOP_TERMS = ["的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一", "个", "这", "那", "什", "么", "怎", "哪"]
MAX_TERMS = 15
#: Keywords by claim type, in order of precedence.
CLAIM_TYPES = [
    ("limitation", ["limitation", "limited", "fail", "cannot"]),
    ("comparison", ["outperform", "better than", "compared", "versus", "vs."]),
    ("method", ["method", "approach", "framework", "model"]),
    ("conclusion", ["conclude", "conclusion", "therefore"]),
]
#: Canonical units by their lower-case spelling without spaces.
UNITS = {"pa*s": "Pa·s", "pas": "Pa·s", "mpa*s": "mPa·s", "pa•s": "Pa·s", "mpa•s": "mPa·s", "s^-1": "s⁻¹", "s-1": "s⁻¹", "min-1": "min⁻¹", "h-1": "h⁻¹"}
#: Ligatures and their letters.
LIGATURES = [("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")]
CJK = "㐀-䶿一-鿿豈-﫿"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_extract(text, r"(?Us)^\s*(.*\S)?", 1)


def collapse(text: Column) -> Column:
    # Single spaces stay as they are, and no other white space is left to strip.
    return F.trim(F.regexp_replace(text, r"(?U)\s{2,}|[^\S ]", " "))


def estimate_tokens(text: Column) -> Column:
    """Latin words, half the CJK characters and a quarter of all others, rounded up; 0 for empty texts, else at least 1."""
    # One pass over the whole text leaves a sign for each word; all else is counted on what is left.
    short = F.regexp_replace(text, "[A-Za-z0-9_./:-]+", "a")
    rest = F.replace(short, F.lit("a"), F.lit(""))
    latin = F.length(short) - F.length(rest)
    signs = F.regexp_replace(rest, r"(?U)\s+", "")
    cjk = F.length(F.regexp_replace(signs, f"[^{CJK}]+", ""))
    other = F.length(signs) - cjk
    whole = lambda c, d: F.floor(c / d)
    total = latin + whole(cjk + 1, 2) + whole(other + 3, 4)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), total)).cast("long")


def query_terms(query: Column) -> Column:
    """Distinct words and single CJK characters in order of appearance, without stop characters."""
    found = F.regexp_extract_all(F.lower(query), F.lit("[A-Za-z0-9_]+|[一-鿿]"), F.lit(0))
    kept = F.filter(found, lambda t: ~t.isin(STOP_TERMS))
    return F.slice(F.array_distinct(kept), 1, MAX_TERMS)


def term_weight(term: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(3.0), F.length(term) / 2))


def relevance(text: Column, terms: Column) -> Column:
    """Sum of the weights of the terms that the text holds."""
    hay = F.lower(text)
    return F.aggregate(F.filter(terms, lambda t: F.contains(hay, t)), F.lit(0.0), lambda a, t: a + term_weight(t))


def snippet(text: Column, query: str, radius: int = 80) -> Column:
    """The first hit with its surroundings, dots where text is left out; without a hit the beginning of the text."""
    at = F.instr(F.lower(text), query.lower())
    start = F.greatest(F.lit(1), at - radius)
    end = F.least(F.length(text), at - 1 + len(query) + radius)
    hit = F.concat(F.when(start > 1, "...").otherwise(""), strip(F.substring(text, start, end - start + 1)), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at > 0, hit).otherwise(strip(F.substring(text, 1, 2 * radius)))


def content_hash(text: Column) -> Column:
    """SHA-256 of the stripped text without white space at line ends."""
    return F.sha2(F.regexp_replace(strip(text), r"(?m)[ \t\r\f]+$", ""), 256)


def summary(text: Column, size: int = 500) -> Column:
    return F.substring(collapse(text), 1, size)


def paragraphs(text: Column) -> Column:
    """Paragraphs on one line each, blank runs collapsed, empty ones dropped, with an empty line between them."""
    parts = F.transform(F.split(text, r"\n\s*\n", -1), lambda p: strip(F.regexp_replace(F.regexp_replace(p, r"\s*\n\s*", " "), r"[ \t]+", " ")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def repair(text: Column) -> Column:
    """Ligatures spelled out, words joined that a line end has split."""
    text = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), LIGATURES, text)
    return F.regexp_replace(text, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")


def references(text: Column) -> Column:
    """struct(body, refs): what stands before and after the first heading line of a reference list; refs may be null."""
    heading = r"(?im)^\s*(references|bibliography|参考文献)\s*$"
    parts = F.split(text, heading, 2)
    after = strip(F.get(parts, F.lit(1)))
    return F.struct(F.when(F.size(parts) > 1, strip(parts[0])).otherwise(text).alias("body"), F.when(after != "", after).alias("refs"))


def captions(text: Column) -> Column:
    """struct(body, captions): caption lines of figures and tables taken out of a text."""
    pattern = r"(?i)^\s*((fig\.|figure|table)\s+\d+[\w.:-]*\s+.+)$"
    lines = F.split(text, "\n", -1)
    return F.struct(
        F.array_join(F.filter(lines, lambda s: ~strip(s).rlike(pattern)), "\n").alias("body"), F.transform(F.filter(lines, lambda s: strip(s).rlike(pattern)), strip).alias("captions")
    )


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("[^。！？.!?]+[。！？.!?]?"), F.lit(0)), strip), lambda s: s != "")


def claim_sentences(text: Column) -> Column:
    return F.transform(F.split(text, r"(?<=[.!?。！？])\s+|\n+", -1), collapse)


def claim_type(text: Column) -> Column:
    low, out = F.lower(text), None
    for name, words in CLAIM_TYPES:
        found = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise("result")


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"([-+]?(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")


def unit(text: Column) -> Column:
    """Canonical spelling of a unit; unknown ones stay as they are, trimmed."""
    clean = F.replace(F.replace(strip(text), F.lit(" "), F.lit("")), F.lit(" "), F.lit(""))
    low = F.replace(F.lower(clean), F.lit("pa·s"), F.lit("pa*s"))
    known = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, low), F.when(clean.rlike("^[a-zA-Z%]+$"), clean), strip(text), F.lit(""))


def fixed_width(text: Column, size: int = 1200, overlap: int = 120) -> Column:
    """Pieces of ``size`` characters that overlap; the last one ends with the text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - overlap, F.lit(1)), F.lit(size - overlap))
    return F.filter(F.transform(starts, lambda i: strip(F.substring(text, i, F.lit(size)))), lambda p: p != "")


def coalesce_blank(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").when(score.isNotNull(), "low")


def any_marker(text: Column, markers: Sequence[str]) -> Column:
    return F.exists(F.array(*(F.lit(m) for m in markers)), lambda m: F.contains(F.lower(text), m))
