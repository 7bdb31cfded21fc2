"""Queries whose work grows with what is different on a page or in a document, not with the square of its rows."""

import time

from pyspark.sql import functions as F

from docloom.operators.charts import densities
from docloom.operators.evidence import caption_assets
from docloom.operators.fragments import caption_candidates
from docloom.operators.shaping import captions_to_boxes


def joined(df):
    """(rows, most rows that a join of the plan put out)."""
    rows = df.collect()
    seen, most = [df._jdf.queryExecution().executedPlan()], 0
    while seen:
        node = seen.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            seen.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            seen.append(node.plan())
        else:
            if "Join" in name:
                most = max(most, node.metrics().apply("numOutputRows").value())
            seen += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def test_densities_of_copies(spark):
    rows = spark.range(3_000).selectExpr("1L AS doc", "1L AS page", "id AS region", "cast(id % 5 AS double) AS x0", "0D AS y0", "cast(id % 5 + 100 AS double) AS x1", "100D AS y1", "if(id % 2 = 0, 1L, 0L) AS chars")
    got, most = joined(densities(rows.drop("chars"), rows.drop("region")))
    assert len(got) == 3_000 and most <= 6_000
    assert {round(r.text_density, 6) for r in got} == {1.0} and {round(r.image_density, 6) for r in got} == {1.0}
    one = densities(rows.drop("chars").where("region = 7"), rows.drop("region").where("x0 = 2 and chars = 1").limit(3)).first()
    assert round(one.text_density, 6) == round(3 / max(80, 10_000 / 180), 6) and one.image_density == 0


def test_caption_assets_of_copies(spark):
    assets = spark.range(3_000).selectExpr("id", "1L AS doc_id", "concat('Figure ', id % 7) AS label", "concat('Figure ', id % 7, ' red ', id % 3) AS caption")
    refs = spark.range(3_000).selectExpr("id AS ref_id", "1L AS doc_id", "CASE WHEN id % 3 = 0 THEN 'FIGURE 4' WHEN id % 3 = 1 THEN 'RED 2' ELSE ' ' END AS label")
    got, most = joined(caption_assets(refs, assets))
    assert {(r.ref_id % 3, r.asset_id) for r in got} == {(0, 4), (1, 2)} and len(got) == 2_000 and most <= 6_000


def test_captions_to_boxes_of_copies(spark):
    caps = spark.range(3_000).selectExpr("1L AS doc", "1L AS page", "id AS label", "10D AS x0", "300D AS y0", "200D AS x1", "320D AS y1", "600D AS width", "800D AS height")
    boxes = spark.range(3_000).selectExpr("1L AS doc", "1L AS page", "cast(20 + id % 3 AS double) AS x0", "200D AS y0", "90D AS x1", "260D AS y1")
    got, most = joined(captions_to_boxes(caps, boxes))
    assert {(r.x0, r.y1, r.is_default) for r in got} == {(10.0, 270.0, False)} and len(got) == 3_000 and most <= 6_000


def test_captions_of_a_long_text(spark):
    """2,000 captions in one text: they are taken from it once, not once for each caption."""
    body = "\n".join(f"Fig. {i % 1_500}: what the figure of this number shows at length" for i in range(2_000))
    began = time.monotonic()
    got = spark.createDataFrame([(body,)], "t string").select(F.explode(caption_candidates(F.col("t"))).alias("c")).collect()
    assert [r.c.split(":")[0] for r in got] == [f"Fig. {i}" for i in range(1_500)] and time.monotonic() - began < 20
