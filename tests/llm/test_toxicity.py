import math
import random
import zlib

import pytest

from docloom.llm import toxicity as op


def table(spark, n=900):
    r = random.Random(4)
    calm = [f"word{i}" for i in range(300)] + ["you", "your"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(calm) for _ in range(r.randrange(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["you", ""]) + " " + r.choice(["idiot", "stupid!", "zorvex" + r.choice(["ol", "an", "ett", "is"]), "moron"]))
        docs.append((i, " ".join(words), "en", 1.0))
        labels.append((i, 1, int(toxic)))
    docs += [(n, None, "en", 0.0), (n + 1, "", "en", 0.0), (n + 2, "you id1ot you m0ron st*pid", "xx", 0.0), (n + 2, "plain", "xx", 0.0), (None, "plain", None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, margin double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = table(spark)
    model = op.fit(docs, labels)
    got = op.score(docs, model, docs.columns).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.97
    by = {r.text: r.score for r in got if r.doc_id is None or r.doc_id >= 900}
    assert by[None] == by[""] < 0.5 and by["plain"] < 0.5 <= by["you id1ot you m0ron st*pid"]
    kept = op.reject(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1


def test_scores_depend_on_the_text_alone(spark):
    docs, labels = table(spark)
    model = op.fit(docs, labels)
    other = docs.selectExpr("doc_id + 7 as doc_id", "text", "'q' as lang", "margin")
    one = {r.text: r.score for r in op.score(docs, model, ["text"]).collect()}
    assert one == {r.text: r.score for r in op.score(other.repartition(3), model, ["text"]).collect()}


def test_held_out_labels_are_never_used(spark):
    docs, labels = table(spark)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = (sorted((r.text or "", r.score) for r in op.score(docs, op.fit(docs, x), ["text"]).collect()) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("rows", [[], [(1, 1, 1), (2, 1, None), (None, 1, 0)]])
def test_too_few_labels(spark, rows):
    docs, _ = table(spark, 10)
    got = op.score(docs, op.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))).collect()
    assert len(got) == 15 and len({r.score for r in got}) == 1
    assert op.score(docs.limit(0), op.Model(op.Lexicon({}), 0.0)).count() == 0


def test_measures():
    found = op._Findings(op.Lexicon({"idiot": 3.0, "^zorv": 2.0, "stupid": 1.0}))
    m = dict(zip(op.FEATURES, op.measure("You IDIOT!! zorvalon 1d10t st*p*d fine", found), strict=True))
    assert m["hits"] == 4 and m["disguised_hits"] == 2 and m["near_address"] == 4 and m["most_weight"] == 3.0
    assert op.measure("", found) == [0.0] * len(op.FEATURES) == op.measure(" \n", found)


def test_columns_of_any_name_and_labels_that_disagree(spark):
    docs, labels = table(spark)
    docs = docs.selectExpr("*", "1 as _score", "2 as score", "3 as row", "text as x")
    both = labels.unionByName(labels.selectExpr("doc_id", "quality", "case when doc_id % 4 = 0 then 0 else toxic end as toxic"))
    assert op.reject(docs, both.repartition(3)).columns == docs.columns
    a, b = (sorted((r.text or "", r.score) for r in op.score(docs.drop("score"), op.fit(docs, x), ["text"]).collect()) for x in (labels, both))
    assert a == b


def slow_features(text, lexicon):
    """The features word by word and sign by sign, as their names say."""
    found = [(i, raw, *lexicon.find(raw)) for i, raw in enumerate(text.split())]
    if not found:
        return [0.0] * len(op.FEATURES)
    hits, calls = [f for f in found if f[2] > 0], [f for f in found if f[4]]
    kinds = []
    for f in hits:
        if f[2:] not in kinds:
            kinds.append(f[2:])
    near = sum(min((abs(c[0] - h[0]) for c in calls), default=99) <= 5 for h in hits)
    share = lambda signs: sum(c in signs for c in text) / len(text)
    drawn = 0
    for run in ("!!", "??", "aaa", "eee", "ooo", "iii", "uuu", "..."):
        at = text.find(run)
        while at >= 0:
            drawn, at = drawn + 1, text.find(run, at + len(run))
    n = len(found)
    return [
        len(hits), len(hits) / n, sum(f[2] for f in found) / n, max(f[2] for f in found), len(hits) - len(kinds), near, len(calls) / n, sum(f[3] for f in found), sum(f[6] for f in found) / n,
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), sum(f[5] for f in found) / n, share("!"), share("?"), share("!?.,;:"), drawn / len(text), share("0123456789"), math.log1p(n),
    ]


def slow_score(x, model):
    """Trees walked node by node, the curve by interpolation between its bounds."""
    margin = 0.0
    for weight, tree in zip(model.trees.treeWeights, model.trees.trees, strict=True):
        node = tree._java_obj.rootNode()
        while node.subtreeDepth():
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        margin += weight * node.prediction()
    bounds, levels = model.curve.boundaries.toArray(), model.curve.predictions.toArray()
    at = [i for i, b in enumerate(bounds) if b <= margin]
    if not at or margin >= bounds[-1]:
        level = levels[-1] if at else levels[0]
    else:
        i = at[-1]
        level = levels[i] if bounds[i] == margin else levels[i] + (levels[i + 1] - levels[i]) * (margin - bounds[i]) / (bounds[i + 1] - bounds[i])
    return 0.99 * min(1.0, max(0.0, level)) + 0.01 / (1 + math.exp(-2 * margin))


def test_slow_scorer(spark):
    """Every text of a table and of the documents gets the score that plain loops give it."""
    docs, labels = table(spark)
    at = "/root/testdata/sf0.01"
    for rows, known in ((docs.select("doc_id", "text"), labels), (spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{at}/labels.parquet"))):
        model = op.fit(rows, known)
        assert model.trees is not None
        for r in op.score(rows.repartition(3), model, ["doc_id", "text"]).collect():
            want = slow_score(slow_features(r.text or "", model.lexicon), model)
            assert abs(r.score - want) < 1e-9, (r.doc_id, r.score, want)


def test_very_long_text(spark):
    docs, labels = table(spark)
    model = op.fit(docs, labels)
    long = spark.createDataFrame([(1, "word1 you " * 300_000 + "idiot"), (2, "x" * 2_000_000)], "doc_id long, text string")
    assert [0 <= r.score <= 1 for r in op.score(long, model).collect()] == [True, True]
