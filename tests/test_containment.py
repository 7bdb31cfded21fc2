from docloom.operators.relational import holders


def test_items_of_any_number_of_words(spark):
    """Items of one character to many words, at word ends and within words, with signs of patterns and beyond ASCII."""
    docs = [(1, "alpha beta gamma delta"), (2, "xalpha beta gammax"), (3, "a.b (c) [d"), (4, "é😀ü"), (5, ""), (6, None), (7, "beta  gamma"), (8, "line\nbeta gamma\tdelta")]
    items = [(1, "beta gamma"), (2, "a"), (3, "é😀"), (4, "a.b"), (5, "alpha beta gamma"), (6, "(c) [d"), (7, "missing"), (8, ""), (9, None), (10, " "), (11, "pha beta gam"), (12, "\n"), (13, "beta gamma\tdelta")]
    got = {(r.item_id, r.doc_id) for r in holders(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).distinct().collect()}
    assert got == {(i, d) for i, t in items for d, s in docs if t and s is not None and t in s}


def test_many_short_items_are_no_single_row(spark):
    items = spark.range(3_000).selectExpr("id as item_id", "concat('w', id) as text")
    docs = spark.createDataFrame([(1, "w12 w2999x"), (2, "none")], "doc_id long, text string")
    assert {(r.item_id, r.doc_id) for r in holders(items, docs).collect()} == {(k, 1) for k in (1, 2, 12, 29, 299, 2999)}
