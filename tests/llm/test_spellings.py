import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from docloom.llm import spellings as op

SMALL = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    n = {w: c for w, c in counts.items() if c >= 2}
    keys = {}
    for w in n:  # near words share a string with one character less
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            keys.setdefault(k, []).append(w)
    around = {w: set() for w in n}
    for some in keys.values():
        for a in some:
            around[a] |= {b for b in some if a != b and near(a, b)}
    best = {w: min(around[w], key=lambda b: (-n[b], b), default=None) for w in n}
    form = {w: b if b and n[b] >= 10 * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in n), key=repr)


def check(spark, rows, schema="doc_id long, text string", **options):
    df = spark.createDataFrame(rows, schema)
    assert sorted((tuple(r) for r in op.variants(df, **options).collect()), key=repr) == brute([r[:2] for r in rows])


def noise(seed, n, letters="abé", sizes=(7, 8, 9)):
    r = random.Random(seed)
    base = ["".join(r.choices(letters, k=r.choice(sizes))) for _ in range(40)]

    def changed(w):
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            i = r.randrange(len(w))
            w = r.choice((w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]))
        return w

    return [(k, " ".join(changed(r.choice(base[: r.choice((3, 40))])) for _ in range(60))) for k in range(n)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("letters", "sizes"), [("ab", (7, 8)), ("abcdé", (5, 7, 9, 14))])
def test_pairs_of_a_trie(seed, letters, sizes):
    r = random.Random(seed)
    words = sorted({"".join(r.choices(letters, k=r.choice((size, size - 1)))) for size in (r.choice(sizes),) for _ in range(150)})
    size = max(map(len, words))
    got = op.errata_pairs(words, size)
    assert len(got) == len({frozenset(p) for p in got})
    want = {frozenset((i, j)) for i in range(len(words)) for j in range(i) if near(words[i], words[j]) and max(len(words[i]), len(words[j])) == size}
    assert {frozenset(p) for p in got} == want


@pytest.mark.parametrize("group_words", [20_000, 100, 8])
def test_brute_force(spark, group_words):
    check(spark, noise(1, 80), group_words=group_words)


def test_brute_force_of_more_letters(spark):
    check(spark, noise(2, 200, "abcdefghijklmnopq", (7, 8, 10, 15)), group_words=5)


ODD = [
    (None, "doubled doubled  Doubled DOUBLED"), (None, None), (1, ""), (1, "ÀÉÎ×÷ÿaa ÀÉÎ×÷ÿaa ÀÉÎ×÷ÿab àéîabcdé"), (2, "short a b c"), (2, "x" * 9_000), (3, "x" * 9_000 + " " + "x" * 8_999), (4, "x" * 8_999 + "y " + "x" * 8_999),
    *((10, "aaaaaaaa aaaaaaa") for _ in range(30)), *((11 + i, "aaaaaaab baaaaaaa abaaaaaa") for i in range(3)), (20, "Ωaaaaaaab ωaaaaaaab ﬁaaaaaab"),
]


def test_odd_rows_ties_and_long_words(spark):
    check(spark, ODD)
    check(spark, [(*r, "w", 1) for r in ODD], "doc_id long, text string, word string, n int", group_words=2)


def test_chain_of_forms(spark):
    rows = [(i, t) for i, t in enumerate(["aaaaaaaaa"] * 2_500 + ["aaaaaaaab"] * 200 + ["aaaaaaabb"] * 15 + ["aaaaaabbb"] * 2)]
    check(spark, rows)


def test_empty_table(spark):
    check(spark, [])


def test_very_long_text(spark):
    check(spark, [(1, "something somethin anything " * 40_000), (2, "something somethinh anything anythinge " * 10)])


def test_documents_by_sql_and_brute_force(spark):
    got = sorted(map(tuple, op.op12_spellings(spark, SMALL).collect()), key=repr)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert got == sorted(c.sql(op.ORACLE_SQL["op12_spellings"]).fetchall(), key=repr)
    assert got == brute(c.sql("SELECT doc_id, text FROM documents").fetchall())
