import base64
import hashlib

import public_tokenizers
import tiktoken
from test_decontamination import brute as leaks
from test_secrets import brute as spans
from test_simhash import classes, slow_fingerprint

import corpus_pipeline as p
from docloom.llm import toxicity

AT = "/root/testdata/sf0.001"


def redacted(text):
    out, at = "", 0
    for start, _, end in spans(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_every_stage(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{AT}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if score[r.doc_id] < 0.5}
    seen, names = docs, []
    for name, stage in p.STAGES:
        made = stage(spark, seen, AT)
        names.append(name)
        if name == "simhash_near_dedup":
            ids = sorted(rows)
            rows = {i: rows[i] for i, c in zip(ids, classes([slow_fingerprint(rows[i]) for i in ids]), strict=True) if ids[c] == i}
        elif name == "benchmark_decontamination":
            rows = {i: rows[i] for i, *_, bad in leaks(list(rows.items()), items) if not bad}
        elif name == "secret_scans":
            rows = {i: redacted(t) for i, t in rows.items()}
        if name != "byte_level_bpe":
            assert sorted(made.columns) == sorted(docs.columns)
            got = made.collect()
            assert {r.doc_id: r.text for r in got} == rows and len(got) == len(rows), name
            assert name != "secret_scans" or all(r.n_chars == len(r.text) for r in got)
            seen = spark.createDataFrame(got, docs.schema)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own3", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: library.encode_ordinary(t) for i, t in rows.items()}
    got = made.collect()
    assert {r.doc_id: r.ids for r in got} == want
    assert all(r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest() for r in got)
    assert sorted(r.doc_id for r in p.run(spark, AT).collect()) == sorted(want)
    assert 4 <= len(names) == len(set(names)) <= 5


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{AT}/{t}.parquet").limit(0 if t == "documents" else 10).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert p.run(spark, f"file://{tmp_path}").count() == 0


def test_repeated_and_null_rows(spark):
    """Of the two equal rows one stays as the near-duplicate it is of the other; null ids and texts go through all stages."""
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, None, None, None, None), (None, "q r s t u v", "x", "y", 3)], spark.read.parquet(f"{AT}/documents.parquet").schema)
    both = [(1, "a b c d"), (2, None), (None, "q r s t u v")]
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, AT)
        want = [*both, (1, "a b c d")] if name == "toxicity" else both
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(want, key=str), name
    last = p.STAGES[-1][1](spark, docs, AT)
    assert sorted(((r.doc_id, len(r.ids)) for r in last.collect()), key=str) == sorted([(1, 4), (2, 0), (None, 6)], key=str)
