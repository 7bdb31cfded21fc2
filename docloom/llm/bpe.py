"""Operator 2, byte-level BPE encoding and decoding by merge replay.

Instead of running the merges word by word, a block of documents is reduced to its distinct words, thousands of them are
laid out as one linked list of tokens, and an inverted index leads from each mergeable token pair to the positions where it
stands. The merges are then replayed in the order of their ranks: a merge visits just the positions in its entry and
updates just the two neighbours of each. A word's ids depend on that word alone, so blocks need no exchange, and the
words a Python worker has replayed are kept for its next blocks in a cache of bounded size.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .shared import text_batches

#: About so many bytes of words and their ids a worker keeps between blocks; beyond, it starts anew and replays them again.
CACHE_BYTES = 50_000_000
#: So many words are laid out as one list and replayed together: their tokens and index stay in a processor's cache, which more do not.
WORDS_AT_ONCE = 4_000
#: Pattern of the contract's tokenizer for texts in which no character is beyond U+024F, a control separator or a number
#: that is no digit; the same matches as public_tokenizers.PATTERN there, in a third of the time.
_LATIN = re.compile(r" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_LATIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba-\xbb\xbf-ɏ]")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a tiktoken file. The file has a fixed size; it is read on the driver and sent once."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Token pairs are held as one number, left * WIDE + right.
WIDE = 1 << 20


def merges(ranks: dict[bytes, int]) -> dict[int, int]:
    """Every pair of tokens whose bytes together are a token, and that token, whose number is also the merge's rank."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None:
                out[left * WIDE + right] = rank
    return out


def replay(words: list[bytes], single: list[int], pairs: dict[int, int]) -> list[bytes]:
    """Token ids of each word, as int32 bytes. Every merge is applied in rank order at all places in all words.

    ``single`` has the tokens of single bytes, ``pairs`` is what ``merges`` made.
    """
    start = np.array(single, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
    size = len(start)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    some = starts[sizes > 0]
    left, right = np.arange(-1, size - 1), np.arange(1, size + 1)
    left[some], right[(starts + sizes - 1)[sizes > 0]] = -1, -1
    # The index: for each merge the places where its pair stands, from left to right; ``due`` is the merge due at a place.
    codes, which = np.unique(start[:-1] * WIDE + start[1:], return_inverse=True)
    due = np.full(size, -1, np.int64)
    due[:-1] = np.array([pairs.get(code, -1) for code in codes.tolist()], np.int64)[which] if size > 1 else -1
    due[right < 0] = -1
    order = np.argsort(due, kind="stable")
    order = order[np.searchsorted(due[order], 0) :]
    ranks = due[order]
    bounds = np.flatnonzero(np.diff(ranks, prepend=-1, append=-1)).tolist()
    at = order.tolist()
    index: dict[int, list[int]] = {rank: at[a:b] for rank, a, b in zip(ranks[bounds[:-1]].tolist(), bounds[:-1], bounds[1:], strict=True)}
    tokens, left, right, due = start.tolist(), left.tolist(), right.tolist(), due.tolist()
    merged = pairs.get
    queue = list(index)  # in order, so a heap
    while queue:
        rank = heapq.heappop(queue)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()  # in a word, from left to right
        wide = rank * WIDE
        for n, i in enumerate(places):
            if due[i] != rank:
                continue
            j = right[i]
            tokens[i], tokens[j] = rank, -1
            right[i] = k = right[j]
            due[i] = due[j] = -1
            sooner = False
            if k >= 0:
                left[k] = i
                if (new := merged(wide + tokens[k])) is not None:
                    due[i] = new
                    if new in index:
                        index[new].append(i)
                    else:
                        index[new] = [i]
                        heapq.heappush(queue, new)
                    sooner = new < rank
            h = left[i]
            if h >= 0:
                if (new := merged(tokens[h] * WIDE + rank)) is None:
                    due[h] = -1
                else:
                    due[h] = new
                    if new in index:
                        index[new].append(h)
                    else:
                        index[new] = [h]
                        heapq.heappush(queue, new)
                    sooner |= new < rank
            if sooner and n + 1 < len(places):  # a merge of lower rank has come up: it goes before the rest of these
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(queue, rank)
                index[rank] += places[n + 1 :]
                break
    flat = np.array(tokens, dtype=np.int32)
    kept = flat >= 0
    counts = np.concatenate([[0], np.cumsum(kept)]) * 4
    raw = flat[kept].tobytes()
    return [raw[a:b] for a, b in zip(counts[starts].tolist(), counts[starts + sizes].tolist(), strict=True)]


class _Encoder:
    """A worker's tokenizer and its cache of words."""

    held: dict[tuple, _Encoder] = {}

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        import public_tokenizers

        self.pattern = regex.compile(pattern)
        self.plain = pattern == public_tokenizers.PATTERN
        self.single, self.pairs = [ranks[bytes([b])] for b in range(256)], merges(ranks)
        self.ids: dict[str, bytes] = {}
        self.size = 0

    @classmethod
    def of(cls, key: str, pattern: str, ranks: dict[bytes, int]) -> _Encoder:
        if (key, pattern) not in cls.held:
            cls.held.clear()
            cls.held[key, pattern] = cls(pattern, ranks)
        return cls.held[key, pattern]

    def split(self, text: str) -> list[str]:
        return (_LATIN if self.plain and not _NOT_LATIN.search(text) else self.pattern).findall(text)

    def encode(self, texts: list[str]) -> pa.ListArray:
        split = [self.split(text) for text in texts]
        if self.size > CACHE_BYTES:
            self.ids, self.size = {}, 0
        new = list(set(chain.from_iterable(split)) - self.ids.keys())
        raw = [word.encode() for word in new]
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = slice(at, at + WORDS_AT_ONCE)
            self.ids.update(zip(new[part], replay(raw[part], self.single, self.pairs), strict=True))
        self.size += 200 * len(raw) + 5 * sum(map(len, raw))  # with what Python adds to each entry
        ids = [b"".join(map(self.ids.__getitem__, words)) for words in split]
        offsets = np.cumsum([0, *map(len, ids)]) // 4
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


def _blocks(column: pa.Array, rows: int = 2_000, chars: int = 1_000_000) -> Iterator[list[str]]:
    """The texts of a column in runs of bounded size."""
    block, size = [], 0
    for value in column:
        block.append(value.as_py() or "")
        size += len(block[-1])
        if len(block) >= rows or size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _pieces(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of each token at the place of its rank."""
    pieces: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.binary())


def _bytes_of(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The bytes that each list of ids stands for: the tokens of all lists are taken at once, a list's bytes lie side by side there."""
    flat = pieces.take(ids.flatten())
    if flat.null_count:
        raise KeyError("an id is no token's rank")
    _, bounds, data = flat.buffers()
    starts = np.frombuffer(bounds, np.int32)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_pylist()])
    valid = pc.is_valid(ids).buffers()[1] if ids.null_count else None
    return pa.Array.from_buffers(pa.binary(), len(ids), [valid, pa.py_buffer(starts[ends]), data if data is not None else pa.py_buffer(b"")])


def encode(docs: DataFrame, ranks_path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each whole text, one row for each row of ``docs``.

    With ``decoded``, the name of a third column, the ids are decoded as by ``decode``, in the same Python workers.

    Null and empty texts have no ids. Repeated ids stay separate rows, other columns are ignored. Of a long text all of
    its words are in memory at once; a single word (a run of letters without a break) takes about 100 bytes for each of its own.
    """
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    text_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder.of(ranks_path, pattern, ranks.value)
        pieces = _pieces(ranks.value) if decoded else None
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(1)):
                ids = encoder.encode(block)
                more = [_bytes_of(ids, pieces)] if decoded else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), ids, *more], names)
                at += len(block)

    kind, names = dict(docs.dtypes)[id_col], ["id", "ids", *([decoded] if decoded else [])]
    schema = f"id {kind}, ids array<int>" + (f", `{decoded}` binary" if decoded else "")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``, the bytes that the ids in ``ids_col`` stand for. Null ids give null, no ids no bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    schema = StructType([*encoded.schema.fields, StructField(out, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(ranks.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, _bytes_of(ids, pieces)], [*batch.schema.names, out])

    return encoded.mapInArrow(run, schema)


def digests() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of the columns ids and decoded."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def roundtrip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """The digests of op2: what ``encode`` makes of each text and what its ids decode to."""
    return encode(docs, ranks_path, decoded="decoded").select("doc_id", *digests())


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return roundtrip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op2_bpe": op2_bpe}
ORACLE_SQL: dict[str, str] = {}
