"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding by concatenation."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.vocabularies import ranks_from_tiktoken

#: Distinct words a Python worker remembers; others are folded each time. They have the same ids either way.
REMEMBERED = 600_000
_LONG = 48


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: of its bytes, the adjacent pair of least rank (the first of equals) merges until none has one."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > _LONG:
        return _fold_long(word, ranks)
    get = ranks.get
    parts = [word[k : k + 1] for k in range(len(word))]
    pairs = [get(word[k : k + 2], _NONE) for k in range(len(word) - 1)]
    while pairs and (least := min(pairs)) != _NONE:
        k = pairs.index(least)
        parts[k] += parts.pop(k + 1)
        del pairs[k]
        if k < len(pairs):
            pairs[k] = get(parts[k] + parts[k + 1], _NONE)
        if k:
            pairs[k - 1] = get(parts[k - 1] + parts[k], _NONE)
    return [ranks[part] for part in parts]


_NONE = 1 << 62


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges from a heap, for words of any length."""
    end = list(range(1, len(word) + 1))  # by a piece's first byte: where it ends
    before = list(range(-1, len(word) - 1))
    alive = [True] * len(word)
    heap = []

    def offer(k: int) -> None:
        if end[k] < len(word):
            stop = end[end[k]]
            rank = ranks.get(word[k:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, k, stop))

    for k in range(len(word)):
        offer(k)
    while heap:
        _, k, stop = heapq.heappop(heap)
        if not alive[k] or end[k] >= len(word) or end[end[k]] != stop:
            continue
        alive[end[k]] = False
        end[k] = stop
        if stop < len(word):
            before[stop] = k
        offer(k)
        if before[k] >= 0:
            offer(before[k])
    return [ranks[word[k : end[k]]] for k in range(len(word)) if alive[k]]


class Words:
    """Ids of words, as little-endian unsigned 32-bit numbers, worked out when first asked for."""

    def __init__(self, ranks: dict[bytes, int], known: dict[str, bytes]) -> None:
        self.ranks, self.known = ranks, known
        self.little = {rank: rank.to_bytes(4, "little") for rank in ranks.values()}

    def __call__(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = b"".join(map(self.little.__getitem__, fold(word.encode(), self.ranks)))
            if len(self.known) < REMEMBERED:
                self.known[word] = ids
        return ids


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of every whole text, each match of ``pattern`` by itself and without special tokens.

    ``ids`` is a binary of little-endian unsigned 32-bit numbers. Null and empty texts have no ids. Other columns are
    ignored; each row counts by itself, and an empty table gives an empty result.
    """
    # Each Python worker has its own copy of a broadcast, and keeps there what words it knows from task to task.
    shared = docs.sparkSession.sparkContext.broadcast({"ranks": ranks_from_tiktoken(vocabulary), "words": {}})

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, ids_of = regex.compile(pattern).findall, Words(shared.value["ranks"], shared.value["words"])
        for batch in batches:
            for part in _slices(batch):
                ids = [b"".join(map(ids_of, find(text.as_py() or ""))) for text in part.column("text")]
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(code, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with ``bytes``: the pieces of all ids, one after the other."""
    pieces = [b""] * (1 + max((ranks := ranks_from_tiktoken(vocabulary)).values(), default=0))
    for token, number in ranks.items():
        pieces[number] = token
    known = encoded.sparkSession.sparkContext.broadcast(pieces)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                piece = known.value.__getitem__
                found = [b"".join(map(piece, np.frombuffer(x.as_py(), "<u4").tolist())) for x in part.column("ids")]
                yield pa.record_batch(
                    [*part.columns, pa.array(found, pa.binary())], names=[*part.schema.names, "bytes"]
                )

    return encoded.mapInArrow(join, encoded.withColumn("bytes", F.lit(b"")).schema)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that results are handed on before they pile up."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    return decode(encode(docs, vocabulary, pattern), vocabulary).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
