"""The postings of a shard are made from its texts at once: no row for each gram of each text."""

import random

import pyarrow as pa
import pytest

from docloom.operators import postings


@pytest.mark.parametrize("at_once", [3, 50, 4_000_000])
def test_grams_and_ids(monkeypatch, at_once):
    monkeypatch.setattr(postings, "AT_ONCE", at_once)
    r = random.Random(2)
    ids = [*r.sample(range(-50, 500), 60), None]
    texts = [[None if r.random() < 0.1 else "".join(r.choice("abc \n\0é\U0001f600") for _ in range(r.randrange(40))) for _ in ids] for _ in range(2)]
    want = {}
    for column in texts:
        for i, text in zip(ids, column, strict=True):
            for at in range(len(text or "") - 2 if i is not None else 0):
                want.setdefault(text[at : at + 3], set()).add(i)
    got = postings.postings_of(pa.table({"shard": pa.array([4] * len(ids), pa.int32()), "id": pa.array(ids, pa.int64()), "c0": texts[0], "c1": texts[1]}))
    assert got.column("gram").to_pylist() == sorted(want) and set(got.column("shard").to_pylist()) == {4}
    assert got.column("ids").to_pylist() == [sorted(want[g]) for g in sorted(want)]


def test_nothing_to_index():
    got = postings.postings_of(pa.table({"shard": pa.array([0, 0], pa.int32()), "id": pa.array(["b", "a"]), "c0": pa.array([None, "ab"], pa.string())}))
    assert got.num_rows == 0


def test_build_counts_no_gram_of_a_text(spark, tmp_path, monkeypatch):
    """A shard's task gets its texts, not their grams."""
    seen = []
    monkeypatch.setattr(postings, "grams", lambda value: seen.append(value), raising=False)
    docs = spark.createDataFrame([(i, f"text {i % 7} of it") for i in range(300)], "doc_id long, text string")
    index = postings.Postings.build(docs, str(tmp_path / "p"), ["text"])
    assert not seen and sorted(r.id for r in index.candidates("T 3 of").collect()) == list(range(3, 300, 7))
