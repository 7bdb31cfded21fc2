import base64
import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from docloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "a", "Hello world, it's 1234 tests!!\n\n  end ", "don't WE'LL", "a\x1cb\x85c d", "½²Ⅷ 三4٣", "日本語テスト emoji 👩‍👩‍👧 x",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 40, "x" * 20_001, "́combining é", "<|endoftext|>", " " * 333 + "z", "abcabcabc_abc__", "ÀÉÎöß straße", "0" * 1000,
]


def test_same_ids_as_the_library(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "clash")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(df, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library.encode_ordinary(TEXTS[r.doc_id] or ""), TEXTS[r.doc_id]
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert all(bytes(r.decoded) == (TEXTS[r.doc_id] or "").encode() for r in back)


def test_query_matches_library_on_documents(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = bpe.op2_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.roundtrip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_other_rank_file_and_pattern(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    own = tiktoken.Encoding("own2", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    text = "Übergrößen und naïveté über alles abababab"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert bpe.encode(df, path, r"\S+|\s+").first().ids == own.encode_ordinary(text)


def test_plain_pattern_finds_the_same():
    """All pairs of the characters for which the quicker pattern stands in."""
    import public_tokenizers
    import regex

    slow = regex.compile(public_tokenizers.PATTERN)
    own = [chr(c) for c in range(0x250) if not bpe._NOT_LATIN.search(chr(c))]
    for a in own:
        text = "".join(a + b for b in own)
        assert bpe._LATIN.findall(text) == slow.findall(text), a


def test_ranks_with_gaps(spark, tmp_path):
    import base64

    ranks = {bytes([b]): 2 * b for b in range(256)} | {b"ab": 700, b"abc": 900}
    path = tmp_path / "gaps.tiktoken"
    path.write_text("".join(f"{base64.b64encode(k).decode()} {v}\n" for k, v in ranks.items()))
    both = bpe.decode(bpe.encode(spark.createDataFrame([(1, "abc xab")], "doc_id long, text string"), str(path)), str(path)).first()
    assert both.ids == [900, 64, 240, 700] and bytes(both.decoded) == b"abc xab"


def test_bytes_of_lists_taken_at_once():
    pieces = bpe._pieces({b"a": 0, b"": 1, "é".encode(): 3})
    ids = pa.array([[0, 3], None, [], [3, 1, 0]], pa.list_(pa.int32()))
    assert bpe._bytes_of(ids, pieces).to_pylist() == ["aé".encode(), None, b"", "éa".encode()]
    assert bpe._bytes_of(ids.slice(1, 3), pieces).to_pylist() == [None, b"", "éa".encode()]
    assert bpe._bytes_of(ids.slice(1, 2), pieces).to_pylist() == [None, b""] and bpe._bytes_of(ids.slice(0, 0), pieces).to_pylist() == []
    with pytest.raises(KeyError):
        bpe._bytes_of(pa.array([[2]], pa.list_(pa.int32())), pieces)


def test_words_are_replayed_in_runs(monkeypatch):
    """However many words are laid out together, a word's ids are its own, and no run is longer than WORDS_AT_ONCE."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = ["", "ab" * 40 + " the then thenthe", " é中\U0001f600 don't  x\n\n", "aaaaaaaaa bbbbbbb cc"]
    sizes, plain = [], bpe.replay

    def counted(words, *rest):
        sizes.append(len(words))
        return plain(words, *rest)

    want = bpe._Encoder(public_tokenizers.PATTERN, ranks).encode(texts).to_pylist()
    monkeypatch.setattr(bpe, "replay", counted)
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 3, raising=False)
    assert bpe._Encoder(public_tokenizers.PATTERN, ranks).encode(texts).to_pylist() == want
    assert max(sizes) == 3 and len(sizes) > 2
