"""Markers taken in order, and the evidence and rejections of fused values, against plain loops."""

import random

from docloom.operators import charts, extraction

MARK = "fig int, marker int, px double, py double, area int, colour string"


def greedy(points, markers):
    kept, out = {f: [(x, y) for g, x, y in points if g == f] for f in {m[0] for m in markers}}, set()
    for fig, marker, x, y, area, colour in sorted(markers, key=lambda m: m[1]):
        if colour == "gray" or area < 35 or any(abs(a - x) < 6 and abs(b - y) < 6 for a, b in kept[fig]):
            continue
        kept[fig].append((x, y))
        out.add((fig, marker))
    return out


def test_suppressed_markers(spark):
    """Crowded figures, a pile of markers at one place and a line in which each waits for the one before."""
    r = random.Random(7)
    points = [(f, r.uniform(0, 60), r.uniform(0, 60)) for f in (1, 2) for _ in range(5)]
    markers = [(1, k, round(r.uniform(0, 60), 1), round(r.uniform(0, 60), 1), r.randrange(30, 60), r.choice(("red", "red", "gray"))) for k in range(250)]
    markers += [(2, 1_000 + k, 30.0, 30.0, 50, "red") for k in range(300)] + [(3, 2_000 + k, 4.0 * k, 0.0, 50, "blue") for k in range(12)] + [(3, 3_000, -6.0, 0.0, 50, "blue"), (3, 3_001, 0.0, 5.9, 50, "blue")]
    got = charts.suppressed_markers(spark.createDataFrame(points, "fig int, px double, py double"), spark.createDataFrame(markers, MARK))
    assert {tuple(m) for m in got.collect()} == greedy(points, markers)
    none = spark.createDataFrame([], MARK)
    assert charts.suppressed_markers(spark.createDataFrame(points, "fig int, px double, py double"), none).collect() == []


def test_evidence_and_rejections(spark):
    rows = [
        (1, "A", "f", "5", "sufficient", 0.5, "e1", ["s1"]), (2, "a ", "F", " 5", "sufficient", 0.9, "e2", ["s2", "s1"]), (3, "a", "f", "5", "insufficient", 0.9, "", None), (4, "a", "f", "9", "unsupported", 0.9, "e4", ["s4"]),
        (5, "b", "f", "1", "sufficient", 0.5, "e5", ["s5"]), (6, "c", "f", "1", "sufficient", 0.5, "e6", ["s6"]), (7, "c", "f", "2", "sufficient", 0.5, None, ["s6", ""]), (8, "c", "f", "2", "sufficient", 0.4, "e8", []),
    ]
    df = spark.createDataFrame([(*r[:4], "", "table", *r[4:]) for r in rows], "seq long, entity string, field string, value string, unit string, source string, status string, confidence double, evidence_id string, supporting array<string>")
    assert {tuple(r) for r in extraction.fused_evidence(df).collect()} == {(2, "s1"), (2, "s2"), (2, "e1"), (5, "s5"), (6, "s6"), (7, "s6")}
    links = {r.seq: (r.group, r.identity, r.n_rejected) for r in extraction.rejected_links(df).collect()}
    assert links.keys() == {6, 7, 8} and links[6] == ("c|f", "e6", 2) and links[8] == ("c|f", "e8", 2)
    assert len(links[7][1]) == 16 and links[7][2] == 2
