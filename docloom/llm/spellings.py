"""Operator 12, spelling variant grouping: errata-trie merging.

Words are counted over all texts. Two words are near if one character inserted, deleted or replaced turns one into the
other. Let u be the longer of a near pair (either, if they are equally long) and ``size`` its length. The edit is at one
place of u, in its first or in its second half; the other half is shared. So each word goes to the groups of words that
share a half with it, once as a word of ``size`` and once as one that is a character shorter, and what is left of it in a
group is the part between ``low`` and ``high``, where the edit must be. A group with more than ``GROUP_WORDS`` words halves
that part again: the edit is in one half of it, the other is shared, too. At a part of one character a group holds no
more words than there are letters, so every group ends up small, whatever the words, and no pair is lost.

In a group the parts form a trie. At each node the heaviest child stays and the light subtrees are merged into it with the
next character replaced by the heavy one or skipped, and with the heavy one put in; a light subtree's terminals that
coincide with terminals there give near pairs. A terminal is in a light subtree of at most log2(n) nodes, so merging
handles n log n terminals. A pair is found once: a skipped character is the last of a run of equal ones, and the
part of the word that holds this place is the only one that reports it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, forget

#: Letters, least length and count of a word, share of occurrences with an error put in, how much more a form counts.
LETTERS, LEAST_CHARS, LEAST_COUNT, ERROR_SHARE, FORM_TIMES = "A-Za-z\\u00C0-\\u00FF", 7, 2, 31, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a group before its part is halved.
GROUP_WORDS = 20_000


def _lower(run: str) -> Column:
    """A-Z only: the built-in function where all is ASCII, a table of letters elsewhere."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, error_share: int = ERROR_SHARE) -> DataFrame:
    """(word, n): runs of letters with their errors put in, of at least ``least_chars`` characters, ``least_count`` times or more.

    An error takes one character away, so no shorter run can give a word, and a maximal run is long enough or is left.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", _lower("run").alias("run"))
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run"))
    runs = runs.select("run", h.alias("h"))
    at = F.expr("cast(h % length(run) as int)")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % error_share == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _parts(words: DataFrame, parts: Column) -> DataFrame:
    """``words`` with a row for each of ``parts`` (size, low, high) and the key of the group that shares all else."""
    rows = words.select("word", "n", F.explode(parts).alias("part")).select("word", "n", "part.*")
    end = F.col("high") - (F.col("size") - F.length("word"))
    return rows.withColumn("key", F.xxhash64("size", "low", "high", F.substring("word", F.lit(1), F.col("low")), F.substring("word", end + 1, F.length("word"))))


def _part(size: str, low: str, high: str) -> Column:
    return F.expr(f"named_struct('size', int({size}), 'low', int({low}), 'high', int({high}))")


def groups(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n, size, low, high, key): each word in all groups it can have near words in, none with over ``group_words`` words."""
    halves = [p for size in ("length(word)", "length(word) + 1") for p in (_part(size, "0", f"({size}) div 2"), _part(size, f"({size}) div 2", size))]
    rows, done = cut(_parts(words, F.array(*halves)), "parts"), None
    while True:
        large = rows.where("high - low > 1").groupBy("key").count().where(F.col("count") > group_words).select("key")
        large = cut(large, "large")
        if large.isEmpty():
            return rows if done is None else done.union(rows)
        kept = rows.join(large, "key", "left_anti").select(*rows.columns)
        done = kept if done is None else done.union(kept)
        again = rows.join(large, "key", "left_semi").where("high - low > 1")
        middle = "(low + high) div 2"
        split = _parts(again.select("word", "n", F.array(_part("size", "low", middle), _part("size", middle, "high")).alias("two")), F.col("two"))
        # A key met by chance may also hold parts of one character: they stay whole.
        done = done.union(rows.join(large, "key", "left_semi").where("high - low <= 1").select(*rows.columns))
        rows = cut(split, "parts")


def _common(a: str, b: str, start: int) -> int:
    end = min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    return start


def errata_pairs(parts: list[str], size: int, after: str = "") -> list[tuple[int, int]]:
    """Places (i, j) in ``parts`` of all that are one edit apart: sorted, different strings of ``size`` characters or one less.

    Pairs of two shorter ones are left to the groups of their own size. ``after`` is the character that follows all parts.
    """
    place = {s: k for k, s in enumerate(parts)}
    pairs: list[tuple[int, int]] = []
    nodes = [(0, len(parts), 0)]
    while nodes:
        low, high, depth = nodes.pop()
        if high - low < 2:
            continue
        first = parts[low]
        depth = _common(first, parts[high - 1], depth)
        path, children = first[:depth], []
        ends_here = len(first) == depth
        start = low + ends_here
        while start < high:
            end = bisect_left(parts, path + chr(ord(parts[start][depth]) + 1), start, high)
            children.append((start, end))
            start = end
        heavy = max(children, key=lambda c: c[1] - c[0])
        heavy_char = parts[heavy[0]][depth]
        if ends_here and heavy_char != after and path + heavy_char in place:
            pairs.append((low, place[path + heavy_char]))
        merged: dict[str, list[int]] = {}
        for child in children:
            nodes.append((*child, depth + 1))
            if child == heavy:
                continue
            char = parts[child[0]][depth]
            for k in range(*child):
                rest = parts[k][depth + 1 :]
                if len(parts[k]) < size:
                    met = [place.get(path + heavy_char + char + rest)]  # heavy character put in
                else:
                    met = [place.get(path + heavy_char + rest), *merged.get(rest, ())]  # replaced
                    merged.setdefault(rest, []).append(k)
                    if char != (rest[:1] or after):
                        met.append(place.get(path + rest))  # skipped
                pairs += [(k, m) for m in met if m is not None]
    return pairs


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("less", pa.int64()), ("near", pa.string())])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of ``groups`` sorted by key: near words of each word within its groups, their number and the best of them."""
    out: list[tuple] = []

    def finish(rows: list[tuple]) -> None:
        apart: dict[tuple, list[tuple]] = {}  # keys are hashes: groups are told apart by what they share
        for word, n, size, low, high in rows:
            end = high - (size - len(word))
            apart.setdefault((size, low, high, word[:low], word[end:]), []).append((word[low:end], word, n))
        for (_, low, high, _, rest), own in apart.items():
            if len(own) < 2:
                continue
            own.sort()
            found: dict[int, tuple] = {}
            for pair in errata_pairs([o[0] for o in own], high - low, rest[:1]):
                for k, m in (pair, pair[::-1]):
                    count, best = found.get(k, (0, (0, "")))
                    mine = (-own[m][2], own[m][1])
                    found[k] = (count + 1, min(best, mine) if count else mine)
            out.extend((own[k][1], count, *best) for k, (count, best) in found.items())

    def table() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), NEAR, strict=True)], schema=NEAR)
        out.clear()
        return made

    key, rows = None, []
    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if len(rows) > 1:
                    finish(rows)
                key, rows = k, []
            rows.append(row)
        if len(out) > 5_000:
            yield table()
    if len(rows) > 1:
        finish(rows)
    if out:
        yield table()


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, near, near_n) for every word with a near one: how many, and the most frequent (ties: the first in code-point order)."""
    rows = groups(words, group_words).select("key", "word", "n", "size", "low", "high").repartition("key").sortWithinPartitions("key")
    found = rows.mapInArrow(_near, "word string, n_near long, less long, near string")
    each = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    return each.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): what is reached by following forms to the last, by doubling the jumps.

    Forms count at least ``FORM_TIMES`` times as much as their words, so there are no circles and few rounds.
    """
    jumps = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "jumps")
    while not jumps.where("moved").isEmpty():
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        made = jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        made = cut(made, "jumps")
        forget(jumps)
        jumps = made
    return jumps.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_words: int = GROUP_WORDS, form_times: int = FORM_TIMES, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs``; ``options`` as of ``vocabulary``.

    Null texts have no words, null ids count as empty ones in the draw of errors, repeated rows count again, and an empty
    table gives no rows. A very long text is one array of its long runs, a very long run is a word like any other.
    Ties between near words go to the smaller in code-point order. Other columns are ignored.
    """
    words = cut(vocabulary(docs, id_col, text_col, **options), "words")
    named = words.join(near_words(words, group_words), "word", "left")
    named = named.withColumn("form", F.when(F.col("near_n") >= form_times * F.col("n"), F.col("near")))
    named = cut(named.select("word", "form", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("form").isNotNull(), F.col("near_n")).alias("form_n")), "forms")
    last = roots(named.where("form is not null"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_spellings": op12_spellings}
ORACLE_SQL = {
    "op12_spellings": r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT)] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS steps),
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM found WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM low),
hashed AS (
  SELECT run, times, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, CAST(length(x) / 2 AS BIGINT) + 1), lambda i: CAST('0x' || x[2 * i - 1:2 * i] AS BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM bytes, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
less AS (SELECT word, n, place, word[1:place - 1] || word[place + 1:] AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS place FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 10 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (word)),
walk AS (SELECT word, word AS last, 0 AS steps FROM formed UNION ALL SELECT k.word, f.form, k.steps + 1 FROM walk k JOIN formed f ON k.last = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(last, steps) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""
}
