r"""Operator 5, secret scans: fixed patterns and sliding-window entropy. DataFrame and SQL functions only.

Spans of a pattern come from the texts between its matches: Spark's ``split`` and ``regexp_extract_all`` cut a text at
the same leftmost, non-overlapping matches, and running sums of their lengths in code points are the offsets.

What the fixed patterns cover is blanked out. Every long run of key characters that is left is a candidate. Over each
candidate a window of ENTROPY_WIDTH characters moves on one character at a time; the counts of the characters in it and
the sum of c * log2(c) are updated for the one that enters and the one that leaves. Where the window's Shannon entropy
reaches the threshold of the candidate's character class it is hot; hot windows that touch make one span, unless the
allow list knows its text or it lacks a digit or a letter (words and numbers alone are no keys).

Time and memory grow in proportion to the text: sums and walks run in pieces of bounded length, so a run or a list of
matches of any length is never copied once for each of its elements.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns by kind, in the order in which kinds are listed, with the part whose length counts and its least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_SIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: Runs are maximal, so a least length in the pattern keeps the same matches as dropping short ones afterwards.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

ENTROPY_WIDTH = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{ENTROPY_WIDTH},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character, of at most log2(16) = 4 for hex digits and log2(20) = 4.32 in a window of 20.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "mixed": 3.8}
#: Spans that are no secrets: runs in keyboard or alphabet order, and examples from public manuals. UUIDs are blanked out in a candidate.
ALLOWED = r"(?i)0123456789|abcdefghij|qwertyuiop|example"
UUID = r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])"

#: Matches that are summed up, characters that a window walks over and characters of a text that are held as one block.
SUM_PIECE, WALK_PIECE, TEXT_BLOCK = 256, 4_096, 4_096

_SPANS = "array<struct<start:int,kind:int,end:int,text:string>>"
_ENDS = "array<struct<a:int,b:int>>"


def _pieces(text: Column, pattern: str, group: int, sign: Column) -> Column:
    """The matches of a pattern, what lies between them and their groups, as an array of one; empty without ``sign``."""
    one = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("vals"),
    )
    return F.when(sign, F.array(one)).otherwise(F.array().cast("array<struct<gaps:array<string>,hits:array<string>,vals:array<string>>>"))


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _located(pieces: str, kind: int, least: int) -> str:
    """SQL: spans of the matches in ``pieces`` whose group has ``least`` characters."""
    hits = "transform(c.hits, (h, i) -> named_struct('gap', length(c.gaps[i]), 'hit', length(h), 'val', length(c.vals[i]), 'text', h))"
    parts = f"transform(sequence(0, cast((size(c.hits) - 1) div {SUM_PIECE} as int)), p -> slice(hs, p * {SUM_PIECE} + 1, {SUM_PIECE}))"
    bases = """aggregate(transform(ps, p -> aggregate(p, 0, (a, x) -> a + x.gap + x.hit)), named_struct('at', 0, 'out', cast(array() as array<int>)),
        (a, n) -> named_struct('at', a.at + n, 'out', array_append(a.out, a.at)), a -> a.out)"""
    spans = f"""flatten(transform(ps, (p, k) -> aggregate(p, named_struct('at', bs[k], 'out', cast(array() as {_SPANS})),
        (a, x) -> named_struct(
            'at', a.at + x.gap + x.hit,
            'out', if(x.val >= {least}, array_append(a.out, named_struct('start', a.at + x.gap, 'kind', {kind}, 'end', a.at + x.gap + x.hit, 'text', x.text)), a.out)),
        a -> a.out)))"""
    return f"flatten(transform(filter({pieces}, c -> size(c.hits) > 0), c -> {_let('hs', hits, _let('ps', parts, _let('bs', bases, spans)))}))"


def _united(spans: str) -> str:
    """SQL: the stretches (a, b) that the spans cover, in order; overlapping and touching ones are one."""
    return f"""aggregate(array_sort({spans}), named_struct('open', cast(null as struct<a:int,b:int>), 'out', cast(array() as {_ENDS})),
        (s, x) -> if(s.open.b >= x.start, named_struct('open', named_struct('a', s.open.a, 'b', greatest(s.open.b, x.end)), 'out', s.out),
            named_struct('open', named_struct('a', x.start, 'b', x.end), 'out', if(s.open is null, s.out, array_append(s.out, s.open)))),
        s -> if(s.open is null, s.out, array_append(s.out, s.open)))"""


def _replaced(text: str, stretches: str, by: str) -> str:
    """SQL: ``text`` with each of the ordered ``stretches`` (u) replaced by the expression ``by``."""
    cut = "if({b} <= {a}, '', substr(array_join(slice(tb, cast({a} div {n} as int) + 1, cast(({b} - 1) div {n} - {a} div {n} as int) + 1), ''), {a} % {n} + 1, {b} - {a}))".format
    before = cut(a="if(i = 0, 0, us[i - 1].b)", b="u.a", n=TEXT_BLOCK)
    after = cut(a="element_at(us, -1).b", b=f"length({text})", n=TEXT_BLOCK)
    body = f"if(size(us) = 0, {text}, concat(array_join(transform(us, (u, i) -> concat({before}, {by})), ''), {after}))"
    blocks = f"if(size(us) = 0, array(), regexp_extract_all({text}, '(?s).{{1,{TEXT_BLOCK}}}', 0))"
    return _let("us", stretches, _let("tb", blocks, body))


#: c * log2(c) for the counts of a window.
_WEIGHT = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(ENTROPY_WIDTH + 2)) + ")"
#: Counts of a window are held five bits each, twelve to a number.
_WORDS = len(ALPHABET) // 12 + 1
_PLACE = "named_struct('at', cast({0} div 12 as int), 'by', cast(5 * ({0} % 12) as int))"
_COUNT = "cast(shiftrightunsigned(s.n[v.{0}.at], v.{0}.by) & 31 as int)"
_CHANGE = f"""if(v.new <=> v.old, 0D, {_WEIGHT}[{_COUNT.format("new")} + 1] - {_WEIGHT}[{_COUNT.format("new")}]
    + if(v.old is null, 0D, {_WEIGHT}[{_COUNT.format("old")} - 1] - {_WEIGHT}[{_COUNT.format("old")}]))"""
#: One step of the walk in piece p of the codes cs: 0 is a blank.
_STEP = f"""transform(array(named_struct('new', {_PLACE.format("cs[i]")}, 'old', if(i - {ENTROPY_WIDTH} >= p * {WALK_PIECE}, {_PLACE.format(f"cs[i - {ENTROPY_WIDTH}]")}, null))), v ->
    transform(array(named_struct(
        'n', transform(s.n, (c, k) -> c + if(k = v.new.at, shiftleft(1L, v.new.by), 0L) - if(v.old is not null and k = v.old.at, shiftleft(1L, v.old.by), 0L)),
        'sum', s.sum + coalesce({_CHANGE}, 0D))), w ->
        transform(array(i - p * {WALK_PIECE} >= {ENTROPY_WIDTH - 1} and w.n[0] & 31 = 0 and {math.log2(ENTROPY_WIDTH)!r}D - w.sum / {ENTROPY_WIDTH} >= x.least - 1e-9D), hot ->
            named_struct('n', w.n, 'sum', w.sum,
                'a', if(hot and (s.a < 0 or i - {ENTROPY_WIDTH - 1} > s.b), i - {ENTROPY_WIDTH - 1}, s.a),
                'b', if(hot, i + 1, s.b),
                'out', if(hot and s.a >= 0 and i - {ENTROPY_WIDTH - 1} > s.b, array_append(s.out, named_struct('a', s.a, 'b', s.b)), s.out)))[0])[0])[0]"""
_WALK = f"""aggregate(
    sequence(p * {WALK_PIECE}, least(p * {WALK_PIECE} + {WALK_PIECE + ENTROPY_WIDTH - 1}, size(cs)) - 1),
    named_struct('n', array_repeat(0L, {_WORDS}), 'sum', 0D, 'a', -1, 'b', -1, 'out', cast(array() as {_ENDS})),
    (s, i) -> {_STEP},
    s -> if(s.a < 0, s.out, array_append(s.out, named_struct('a', s.a, 'b', s.b))))"""
_CLASS = f"case when x.text rlike '^([0-9a-f]+|[0-9A-F]+)$' then {THRESHOLDS['hex']}D when x.text rlike '^[A-Za-z0-9]+$' then {THRESHOLDS['alnum']}D else {THRESHOLDS['mixed']}D end"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _hot(runs: str) -> str:
    """SQL: the spans of hot windows in the candidates ``runs``."""
    codes = f"transform(split(regexp_replace(x.text, {_quoted(UUID)}, repeat(' ', 36)), ''), c -> instr('{ALPHABET}', c))"
    walked = f"flatten(transform(sequence(0, cast((size(cs) - {ENTROPY_WIDTH}) div {WALK_PIECE} as int)), p -> {_WALK}))"
    # Pieces may cut a span in two: one begins where none before touches it and ends where none after does.
    firsts = "filter(transform(hs, (h, k) -> if(k = 0, h.a, if(hs[k - 1].b < h.a, h.a, null))), h -> h is not null)"
    lasts = "filter(transform(hs, (h, k) -> if(k = size(hs) - 1, h.b, if(hs[k + 1].a > h.b, h.b, null))), h -> h is not null)"
    named = "transform(fs, (f, k) -> named_struct('start', x.start + f, 'kind', 3, 'end', x.start + ls[k], 'text', array_join(slice(cc, f + 1, ls[k] - f), '')))"
    one = _let("cs", codes, _let("hs", walked, _let("fs", firsts, _let("ls", lasts, _let("cc", "split(x.text, '')", named)))))
    all_ = f"flatten(transform(transform({runs}, x -> named_struct('start', x.start, 'text', x.text, 'least', {_CLASS})), x -> {one}))"
    return f"filter({all_}, h -> h.text rlike '[0-9]' and h.text rlike '[A-Za-z]' and not (h.text rlike {_quoted(ALLOWED)}))"


def _scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, spans): each row as it is, in a struct of its own so that no name can clash, and its spans."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.withColumns({
        "assign": _pieces(text, ASSIGN, 1, text.rlike(ASSIGN_SIGN)), "access": _pieces(text, ACCESS, 0, F.contains(text, F.lit("AKIA"))), "hex": _pieces(text, HEX, 0, text.rlike(HEX)),
    })
    base = "concat({}, {}, {})".format(_located("assign", 0, 6), _located("access", 1, 20), _located("hex", 2, 24))
    rows = rows.select("row", "text", F.expr(base).alias("base"))
    left = F.when(text.rlike(CANDIDATE), F.expr(_replaced("text", _united("base"), "repeat(' ', u.b - u.a)"))).otherwise("")
    rows = rows.select("row", "base", left.alias("left"))
    rows = rows.select("row", "base", _pieces(F.col("left"), CANDIDATE, 0, F.col("left").rlike(CANDIDATE)).alias("runs"))
    runs = f"filter({_located('runs', 3, ENTROPY_WIDTH)}, x -> x.text rlike '[0-9]' and x.text rlike '[A-Za-z]')"
    return rows.select("row", F.expr(f"array_sort(concat(base, {_hot(runs)}))").alias("spans"))


def scan(docs: DataFrame, text_col: str = "text", out: str = "_spans") -> DataFrame:
    """``docs`` with ``out``: array of (start, kind, end, text) by start, then kind, for every secret in each text.

    Offsets are in code points, the end exclusive; ``kind`` is a place in KINDS. Null and empty texts have none. Each
    row stands by itself, so repeated rows and ids, empty tables and further columns make no difference; a column of
    the name ``out`` is replaced. Long texts take time and memory in proportion to their length.
    """
    return _scanned(docs, text_col).select("row.*", "spans").toDF(*docs.columns, "\0").drop(out).withColumnRenamed("\0", out)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by ``mark`` in the text; overlapping and touching spans become one mark."""
    clean = F.expr(_replaced(f"row.`{text_col}`", _united("spans"), "'" + mark.replace("\\", "\\\\").replace("'", "\\'") + "'"))
    fields = [clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return _scanned(docs, text_col).select(*fields)


def report(docs: DataFrame) -> DataFrame:
    """The digests of op5 for each row of ``docs``."""
    named = "array_join(transform({}, x -> concat_ws(':', element_at(array({}), x.kind + 1), x.start, x.end)), ',')"
    kinds = ", ".join(f"'{kind}'" for kind in KINDS)
    count = lambda kind: F.expr(f"size(filter(_spans, x -> x.kind = {kind}))").cast("long")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.expr(named.format("filter(_spans, x -> x.kind < 3)", kinds)).cast("binary"), 256).alias("base_sha256"),
        F.expr(named.format("_spans", kinds)).alias("spans"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_secrets": op5_secrets}
ORACLE_SQL: dict[str, str] = {}
