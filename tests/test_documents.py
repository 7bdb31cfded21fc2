from docloom.functions import text
from docloom.operators import documents as d
from pyspark.sql import functions as F


def test_token_estimate_agrees(spark):
    rows = ["", "a b c", "中文字", "x" * 50, "été à la", "100% sûr!?", "path/to:file-1.txt", "  ", "日本 mixed text 123"]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", text.estimate_tokens(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == {t: d.tokens_of(t) for t in rows}


def test_headings_make_paths():
    rows = d.chunk_one("before\n\n# Intro\nText one.\n\n## Details\nText two.\n\n# Next\nText three.", [], None, d.Sizes(least=0))
    assert [r[2] for r in rows] == ["", "Intro", "Intro > Details", "Next"]


def test_long_text_is_packed_with_overlap():
    words = [f"word{i}" for i in range(1800)]
    body = ". ".join(" ".join(words[i : i + 12]) for i in range(0, 1800, 12)) + "."
    rows = d.chunk_one(body, [], None, d.Sizes(100, 160, 20, 0))
    assert len(rows) > 5 and all(d.tokens_of(r[1]) <= 160 for r in rows)
    assert set(words) <= set(" ".join(r[1] for r in rows).replace(".", " ").split())
    assert any(set(a[1].split()) & set(b[1].split()) for a, b in zip(rows, rows[1:], strict=False))


def test_hard_split_and_coverage():
    body = " ".join(f"w{i}" for i in range(1000))
    rows = d.chunk_one(body, [], None, d.Sizes(100, 160, 20, 0))
    assert all(r[3] for r in rows) and " ".join(r[1] for r in rows) == body


def test_hard_split_counts_a_word_once(monkeypatch):
    calls, count = [], d._counts
    monkeypatch.setattr(d, "_counts", lambda s: calls.append(s) or count(s))
    d._packed_word.cache_clear()
    pieces = list(d.pack("word 数据 a,b - " * 2_000, d.Sizes(200, 300, 20, 50)))
    assert len(pieces) > 10 and all(hard for _, hard, _ in pieces) and len(calls) < 50
    assert [n for _, _, n in pieces] == [d.tokens_of(p) for p, _, _ in pieces] and max(n for _, _, n in pieces) <= 300


def test_small_neighbours_merge_once():
    rows = d.merge_small([["body", "a", "s", False], ["body", "b", "s", False], ["body", "c", "s", False], ["caption", "d", "", False]], d.Sizes(least=10))
    assert [r[1] for r in rows] == ["a\n\nb", "c", "d"]


def test_reference_entries():
    assert d.reference_entries("[1] First. [2] Second.\n[3] Third\n continued\nhttps://x.org/y") == ["[1] First.", "[2] Second.", "[3] Third continued", "https://x.org/y"]


def test_clean_pages(spark):
    pages = [(1, p, f"Journal of Things {p}\n{'abcdef'[p]} opens\nBody ﬁne line {p} exam-\nple here.\nFigure {p} A caption of it\n{'uvwxyz'[p]} closes\nPage {p}") for p in range(1, 6)] + [(1, 6, "References\n[1] Someone."), (2, 1, "single page"), (3, 1, None)]
    got = {r.doc_id: r for r in d.clean_pages(spark.createDataFrame(pages, "doc_id long, page int, text string")).collect()}
    one = got[1]
    assert "Journal" not in one.cleaned and "Page" not in one.cleaned and "fine line 3 example here." in one.cleaned
    assert len(one.captions) == 5 and one.refs == "[1] Someone." and one.page_count == 6
    assert got[2].cleaned == "single page" and got[3].cleaned == ""


def test_html():
    got = d.read_html('<html><head><title> A  b </title><meta name="Description" content="About it"><style>x{}</style></head><body><script>var t="</p>";</script><p>One <b>two</b></p><div>three &amp; four<br>five</div><svg>no</svg></body>')
    assert got == ("A b", "About it", "A b One two three & four five")
    assert d.read_html(None) == ("", "", "")


def test_chunks_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "中文段落。第二句！"), (4, "Table 1 Values of x\nText.")], "doc_id long, text string")
    got = d.chunk_documents(df).collect()
    assert {r.doc_id for r in got} == {3, 4} and [r.chunk_type for r in got if r.doc_id == 4] == ["body", "caption"]


def test_unpivot_of_whole_texts(spark):
    from docloom.operators import shaping

    at = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{at}/conversations.parquet").collect()
    want = sorted((r.conv_id, r.turn, i, i % 3, w) for r in rows for i, w in enumerate((r.text or "").split(" ")) if w)
    assert max(x[2] for x in want) > 5
    assert sorted(tuple(r) for r in shaping.arr11_unpivot_all(spark, at).collect()) == want


def test_whole_tables(spark, tmp_path):
    from docloom.operators import relational, retrieval

    at = f"file://{tmp_path}"
    docs = [(1, "a\nb \n \n c\tc\n\n\n\n d", 1500), (2, "one", 10), (3, "", 500), (5, "x\n\n\n", 500)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 0), (3, 1), (7, 0)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "O"), (2, "F"), (9, "P")], "o_orderkey long, o_orderstatus string").write.parquet(f"{at}/orders.parquet")
    assert {tuple(r) for r in retrieval.str9_paragraphs_all(spark, at).collect()} == {(1, "a b\n\nc c\n\nd"), (2, "one"), (3, ""), (5, "x")}
    assert {tuple(r) for r in relational.dml9_upsert_all(spark, at).collect()} == {(1, 1), (2, 0), (3, 1), (5, None), (7, 0)}
    assert {tuple(r) for r in relational.dml11_migrate_all(spark, at).collect()} == {(1, "queued"), (2, "succeeded"), (9, "running"), (3, "succeeded"), (7, "succeeded")}


def test_names_that_meet(spark):
    from docloom.operators import library

    names = ["a.txt", "a.txt", "a-1.txt", "a.txt", "b", "b", "a-1.txt", "c.pdf"]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)], "k long, f string, _x string")
    used, want = set(), []
    for n in names:
        stem, dot, end = n.partition(".")
        c, i = n, 1
        while c in used:
            c, i = f"{stem}-{i}{dot}{end}", i + 1
        used.add(c)
        want.append(c)
    got = library.file_names(df, "f", "k")
    assert [r.unique_name for r in got.orderBy("k").collect()] == want and got.columns == ["k", "f", "_x", "unique_name"]


def test_holders_of_short_items(spark):
    from docloom.operators import relational

    docs = [(1, "foo barbaz qux and more"), (2, "nothing"), (3, "x foo bar y z"), (4, ""), (5, None)]
    items = [(1, "foo bar"), (2, "nothing"), (3, "oo bar y z"), (4, ""), (5, "absent"), (6, "foo barbaz qux a"), (7, None)]
    got = relational.holders(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted((d, i) for d, t in docs for i, w in items if w and t and w in t)
