import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from docloom.llm import sharding
from docloom.llm.sharding import interleave

SCHEMA = "doc_id long, text string, source string, shard string"


def check(rows, n_shards, out):
    assert len(out) == len(rows)
    counts, slots = Counter(r.shard for r in out), defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max((counts[i] for i in range(n_shards))) - min(counts[i] for i in range(n_shards)) <= 1
    want = Counter((a, len((b or "").encode()) + 16, zlib.crc32((b or "").encode())) for a, b, *_ in rows)
    assert want == Counter((r.doc_id, r.size, r.text_crc32) for r in out)


def test_mixture_and_counts(spark):
    rows = [(i, f"té {i % 50}", None if i % 97 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}", "x") for i in range(9000)]
    rows += [(1, "again", "hot", "x")] * 5 + [(None, None, "hot", None), (7, "", "s1", "x")]
    out = interleave(spark.createDataFrame(rows, SCHEMA).repartition(5), 40).collect()
    check(rows, 40, out)
    where = defaultdict(Counter)
    crc = {(a, zlib.crc32((b or "").encode())): c for a, b, c, _ in rows}
    for r in out:
        where[crc[r.doc_id, r.text_crc32]][r.shard] += 1
    for source, got in where.items():
        want = sum(c == source for *_, c, _ in rows) / 40
        assert all(abs(got[s] - want) <= 2 for s in range(40)), source


def test_same_result_for_any_partitioning(spark):
    rows = [(i, f"t{i}", f"s{i % 3}", "x") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = {(r.doc_id, r.shard, r.slot) for r in interleave(df.coalesce(1), 7).collect()}
    assert one == {(r.doc_id, r.shard, r.slot) for r in interleave(df.repartition(9), 7).collect()}


def test_empty_and_fewer_rows_than_shards(spark):
    assert interleave(spark.createDataFrame([], SCHEMA), 40).count() == 0
    check([(1, "a", "s", "")], 40, interleave(spark.createDataFrame([(1, "a", "s", "")], SCHEMA), 40).collect())


def brute(rows, n_shards, seed=42):
    """The placement by two sorts: (id, crc, shard, slot)."""
    strata = defaultdict(list)
    for i, text, source, *_ in rows:
        key = hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        raw = (text or "").encode()
        strata["" if source is None else "=" + source].append((key, i is not None, i or 0, zlib.crc32(raw), len(raw) + 16))
    phase = {name: int(hashlib.md5(f"{seed}/{name}".encode()).hexdigest()[:8], 16) / 16**8 for name in strata}
    merged = sorted(((k + phase[name]) / len(own), name, row) for name, own in strata.items() for k, row in enumerate(sorted(own)))
    n, out = len(merged), []
    for place, (_, _, (_, known, i, crc, _)) in enumerate(merged):
        shard = place * n_shards // n
        out.append((i if known else None, crc, shard, place - -(-shard * n // n_shards)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("bucket_rows", "run_buckets"), [(500, 4_096), (3, 4)])
def test_brute_force(spark, monkeypatch, bucket_rows, run_buckets):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(sharding, "RUN_BUCKETS", run_buckets)
    rows = [(i, f"té {i % 50}", None if i % 97 == 0 else "hot" if i % 3 else f"s{i % 5}", "x") for i in range(700)]
    rows += [(1, "again", "hot", "x")] * 3 + [(None, None, "hot", None), (None, "b", "", None)]
    out = interleave(spark.createDataFrame(rows, SCHEMA).repartition(3), 40).collect()
    assert sorted(((r.doc_id, r.text_crc32, r.shard, r.slot) for r in out), key=str) == brute(rows, 40)


def test_documents(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    out = sharding.op1_interleave(spark, "/root/testdata/sf0.01").collect()
    assert sorted(((r.doc_id, r.text_crc32, r.shard, r.slot) for r in out), key=str) == brute(rows, 40)


def test_strata_of_one_row_share_no_span(spark):
    """20,000 strata of one row: no span holds many more rows than a bucket, and every shard gets its part of them."""
    rows = [(i, "t", f"host {i}", "x") for i in range(20_000)]
    ranked, n = sharding.fractions(spark.createDataFrame(rows, SCHEMA).repartition(4), "source", 42, "doc_id", "text")
    assert n == 20_000
    assert ranked.groupBy("span").count().agg({"count": "max"}).first()[0] < 1.5 * sharding.BUCKET_ROWS
    check(rows, 40, interleave(spark.createDataFrame(rows, SCHEMA), 40).collect())
