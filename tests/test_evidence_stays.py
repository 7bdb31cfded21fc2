"""Plans go to the texts: neither texts nor vectors are shuffled to plans, and shared labels are one before they are."""

import random

import pytest

from docloom.operators.plan_evidence import evidence_for, meant


@pytest.fixture
def no_small_joins(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_texts_are_not_shuffled(spark, no_small_joins):
    r = random.Random(4)
    words = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(4_000))
    chunks = spark.createDataFrame([(i % 3, i, words() + " needle", [float(i % 7), 1.0], "text", '{"section": "part 2"}') for i in range(500)], "doc int, chunk int, text string, embedding array<double>, chunk_type string, metadata string")
    sources = spark.createDataFrame([(i % 3, ("section", "table", "figure")[i % 2], i, f"Part {i % 4}", words() + " needle") for i in range(500)], "doc int, kind string, seq int, label string, body string")
    pictures = spark.createDataFrame([], "doc int, seq int, label string")
    wanted = spark.createDataFrame([(d, f"f{d}{n}", "", ["needle"], q, False, [], [], []) for d in range(3) for n, q in enumerate([[1.0, 1.0], [0.0, 0.0]])], "doc int, field string, entity string, keywords array<string>, q array<double>, needs_figure boolean, sections array<string>, tables array<string>, figures array<string>")
    before = shuffled(spark)
    got = meant(wanted, chunks, sources).collect()
    assert {(r.kind, r.label) for r in got} == {("section", "Part 2")}
    rows = evidence_for(wanted, chunks, sources, pictures).collect()
    assert {(r.kind, r.label) for r in rows} >= {("section", "Part 2"), ("table", "Part 1")}
    assert shuffled(spark) - before < 1_000_000  # the texts are 4 MB
