"""Removal of passages that an earlier document has too, found at the positions of a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.shared import drop_stage, stage

#: Words of a window.
LENGTH = 50
#: A perfect difference set: each number below the period is the difference of two of its members, modulo the period.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
#: A key with at least this share of all counted rows is joined by broadcast: there can't be more than its inverse of them.
HOT_SHARE = 1 / 10_000

_BATCH_BYTES = 4 << 20
_SPANS = "array<struct<s:bigint,e:bigint>>"
_UNIT = ["doc_id", "key"]


class Cover:
    """The anchors of a text: cover positions from which a whole gram of words follows.

    Any two windows i and j have a common shift below the period at which both i and j are at cover positions, and the
    ``length - period + 1`` words from there on lie within both windows.
    """

    def __init__(self, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> None:
        if not 0 < period <= length or {(a - b) % period for a in cover for b in cover} != set(range(period)):
            raise ValueError("the cover must have all differences modulo a period not above the window's length")
        self.length, self.period, self.gram = length, period, length - period + 1
        self.places = np.array(sorted(cover))

    def anchors(self, n_words: int) -> np.ndarray:
        if n_words < self.length:
            return np.empty(0, np.int64)
        at = (np.arange(0, n_words, self.period)[:, None] + self.places[None, :]).ravel()
        return at[: np.searchsorted(at, n_words - self.gram, side="right")]

    def starts(self, at: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the windows that hold the gram of an anchor."""
        return np.maximum(at - self.period + 1, 0), np.minimum(at, n_words - self.length)


def _words(text: bytes) -> tuple[bytes, int, np.ndarray]:
    """All words joined by one space, their number, and where each begins (one more for the end)."""
    words = text.split()
    begin = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=begin[1:])
    return b" ".join(words), len(words), begin


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.append(0, np.cumsum([len(x) for x in values])), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values), kind))


def _digests(body: bytes, low: np.ndarray, high: np.ndarray, seed: int) -> np.ndarray:
    import xxhash

    found = [xxhash.xxh3_64_intdigest(body[a:b], seed) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    return np.array(found, np.uint64).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def anchored(docs: DataFrame, cover: Cover) -> DataFrame:
    """Staged ``uid, doc_id, key, n_words, words_sha256, grams``: a hash of the words at each anchor, in order of place."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            plain = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=False)]
            return pa.record_batch(
                [*plain, _lists(columns[4], pa.int64())], names=["doc_id", "key", "n_words", "words_sha256", "grams"]
            )

        for batch in batches:
            rows, size = [], 0
            texts = batch.column(2).cast(pa.binary())
            for doc_id, key, text in zip(batch.column(0), batch.column(1), texts, strict=True):
                body, n, begin = _words(text.as_py())
                at = cover.anchors(n)
                grams = _digests(body, begin[at], begin[at + cover.gram] - 1, 0)
                rows.append((doc_id.as_py(), key.as_py(), n, hashlib.sha256(body).hexdigest(), grams))
                size += len(body)
                if size >= _BATCH_BYTES:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)

    found = _keyed(docs).mapInArrow(find, "doc_id long, key long, n_words long, words_sha256 string, grams array<long>")
    return stage(found.select(F.monotonically_increasing_id().alias("uid"), "*"), "anchors")


def join_keyed(rows: DataFrame, keyed: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """``rows`` joined with ``keyed(*keys, n, ...)``, one row a key, where ``n`` rows of ``rows`` have that key.

    Keys with at least ``share`` of all rows counted, of which there are at most ``1 / share``, are broadcast, so that their
    rows stay where they are; only rows of other keys are shuffled. Both inputs are read twice: stage them.
    """
    least = keyed.agg(F.greatest(F.sum("n") * share, F.lit(2.0)).alias("least")).scalar()
    hot = F.broadcast(keyed.where(F.col("n") >= least))
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(keyed.where(F.col("n") < least), keys))


def _merged(spans: DataFrame) -> DataFrame:
    """``doc_id, key, n_removed, spans`` of overlapping or touching ``spans(doc_id, key, s, e)``."""
    window = Window.partitionBy(*_UNIT).orderBy("s", "e")
    before, upto = window.rowsBetween(Window.unboundedPreceding, -1), window.rowsBetween(Window.unboundedPreceding, 0)
    return (
        spans.distinct()
        .withColumn("reach", F.max("e").over(before))
        .withColumn("run", F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(upto))
        .groupBy(*_UNIT, "run")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .groupBy(*_UNIT)
        .agg(F.sum(F.col("e") - F.col("s")).alias("n_removed"), F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    )


def _pieces(bodies: DataFrame, cover: Cover) -> DataFrame:
    """``doc_id, key, gram, piece, s, e`` of the marked anchors of ``bodies``: the piece's hash, and its words [s, e).

    The piece of an anchor is all that the windows with its gram reach.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            columns = (batch.column(c) for c in ("doc_id", "key", "marks", "grams"))
            for doc_id, key, marks, grams, text in zip(*columns, texts, strict=True):
                body, n, begin = _words(text.as_py())
                marked = np.array(marks.as_py(), np.int64)
                first, last = cover.starts(cover.anchors(n)[marked], n)
                end = last + cover.length
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(marked), doc_id.as_py()), pa.int64()),
                        pa.array(np.full(len(marked), key.as_py()), pa.int64()),
                        pa.array(np.array(grams.as_py(), np.int64)),
                        pa.array(_digests(body, begin[first], begin[end] - 1, 1)),
                        pa.array(first),
                        pa.array(end),
                    ],
                    names=["doc_id", "key", "gram", "piece", "s", "e"],
                )

    return bodies.select(*_UNIT, "marks", "grams", "text").mapInArrow(
        find, "doc_id long, key long, gram long, piece long, s long, e long"
    )


def _windows(asked: DataFrame, length: int) -> DataFrame:
    """``doc_id, key, s, digest`` of all windows that lie in the ``spans`` of ``asked(doc_id, key, text, spans)``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for doc_id, key, text, spans in zip(*(batch.column(i) for i in range(4)), strict=True):
                body, _, begin = _words(text.as_py().encode())
                for span in spans.as_py():
                    for low in range(span["s"], span["e"] - length + 1, 1 << 16):
                        start = np.arange(low, min(low + (1 << 16), span["e"] - length + 1))
                        edges = zip(begin[start].tolist(), (begin[start + length] - 1).tolist(), strict=True)
                        yield pa.record_batch(
                            [
                                pa.array(np.full(len(start), doc_id.as_py()), pa.int64()),
                                pa.array(np.full(len(start), key.as_py()), pa.int64()),
                                pa.array(start),
                                pa.array([xxhash.xxh3_128_digest(body[a:b]) for a, b in edges], pa.binary()),
                            ],
                            names=["doc_id", "key", "s", "digest"],
                        )

    return asked.select(*_UNIT, "text", "spans").mapInArrow(find, "doc_id long, key long, s long, digest binary")


def _cut(partly: DataFrame) -> DataFrame:
    """``doc_id, key, kept_text``: the words outside of ``spans``, joined by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, spans in zip(batch.column(2), batch.column(3), strict=True):
                words, at, out = text.as_py().encode().split(), 0, []
                for span in spans.as_py():
                    out += words[at : span["s"]]
                    at = span["e"]
                kept.append(b" ".join(out + words[at:]).decode())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(kept, pa.string())], names=[*_UNIT, "kept_text"])

    return partly.select(*_UNIT, "text", "spans").mapInArrow(cut, "doc_id long, key long, kept_text string")


def cut_passages(
    docs: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, words_sha256, n_removed, spans, kept_text``.

    A word is removed if a window of ``length`` words that covers it also starts in a document with a smaller doc_id. Words are
    runs without ASCII white space. ``spans`` are the removed ranges of word numbers (null: none), ``kept_text`` the other words
    joined by one space (null where nothing is removed: all words stay), ``words_sha256`` the digest of all words joined that way.

    Only cover positions are hashed. Documents that share an anchor and the whole piece round it settle all the
    piece's windows at once by the smallest id. Where an anchor stands in different pieces, each piece is taken once, from its
    first document, and the anchor is extended to either side window by window, as far as windows equal those of an earlier document.
    Equality is that of digests: 128 bits for a window, and for a piece 64 of its gram with 64 more of its own.

    Null and empty texts have no words; texts below ``length`` words keep them all. Rows that repeat with one doc_id don't remove each other,
    nor does a row without doc_id lose or remove anything. Other columns are ignored. An empty table gives an empty result.
    """
    places = Cover(length, period, cover)
    rows = anchored(docs, places)
    anchors = rows.where("doc_id is not null").select("uid", F.posexplode("grams").alias("k", "gram"))
    grams = stage(anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    marks = join_keyed(anchors, grams, ["gram"]).groupBy("uid").agg(F.collect_list(F.struct("k", "gram")).alias("x"))
    marked = marks.join(rows.select("uid", *_UNIT), "uid").select(*_UNIT, F.col("x.k").alias("marks"), F.col("x.gram").alias("grams"))
    bodies = stage(
        _keyed(docs).join(marked.dropDuplicates(_UNIT), _UNIT).dropDuplicates(_UNIT), "bodies"
    )
    shared = stage(_pieces(bodies, places), "shared")
    first = F.min(F.struct("doc_id", "key", "s", "e")).alias("first")
    pieces = stage(
        shared.groupBy("gram", "piece").agg(F.count("*").alias("n"), F.max("doc_id").alias("high"), first), "pieces"
    )
    settled = join_keyed(shared, pieces, ["gram", "piece"]).where("doc_id > first.doc_id").select(*_UNIT, "s", "e")
    mixed = stage(
        pieces.groupBy("gram").agg(F.count("*").alias("n"), F.min("first.doc_id").alias("low"), F.max("high").alias("high"))
        .where("n > 1 and low < high").select("gram", "n"),
        "mixed",
    )
    asked = _merged_reaches(join_keyed(pieces.select("gram", "first"), mixed, ["gram"]).select("first.*"), length)
    windows = stage(_windows(bodies.select(*_UNIT, "text").join(asked, _UNIT), length), "windows")
    least = stage(
        windows.groupBy("digest")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high").drop("high"),
        "least",
    )
    extended = join_keyed(windows, least, ["digest"]).where("doc_id > low").select(*_UNIT, "s", (F.col("s") + length).alias("e"))
    spans = stage(_merged(settled.unionByName(extended)), "spans")
    for used in (grams, shared, pieces, mixed, windows, least):
        drop_stage(used)
    slim = rows.select(*_UNIT, "n_words", "words_sha256")
    kept = _cut(bodies.select(*_UNIT, "text").join(spans, _UNIT))
    return slim.join(spans.join(kept, _UNIT), _UNIT, "left").select(
        "doc_id", "n_words", "words_sha256", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), "spans", "kept_text"
    )


def _merged_reaches(reaches: DataFrame, length: int) -> DataFrame:
    """``doc_id, key, spans``: reaches (s, e) that have a window start in common or side by side, made one.

    Two reaches that only share words keep their own windows: no window is hashed that holds no whole gram of either.
    """
    starts = reaches.withColumn("e", F.col("e") - length + 1)
    longer = lambda x: F.struct(x["s"].alias("s"), (x["e"] + length - 1).alias("e"))
    return _merged(starts).select(*_UNIT, F.transform("spans", longer).alias("spans"))
