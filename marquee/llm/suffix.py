"""Removal of long byte strings that occur twice, by a column-wise sort of suffixes of many documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.hashing import mix
from marquee.llm.shared import content_key, drop_stage, split_by_key, stage

LENGTH = 400
GRAM = 64
#: Anchors with more different pieces than this are compared by window digests, row by row, instead of in one task.
MAX_GROUP = 16_384
_CHUNK = 1 << 18
_BATCH_PIECES = 4096

_SPAN = "array<struct<s:bigint,e:bigint>>"


class Anchors:
    """For each window of ``length`` bytes, the place of its least 64-byte hash (the first of equals).

    The place depends on the window's bytes alone, so that equal windows have their anchor at the same distance.
    """

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram = length, gram
        self.bytes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _grams(self, data: np.ndarray) -> np.ndarray:
        value, width = self.bytes[data], 1
        while width < self.gram:
            step = min(width, self.gram - width)
            value = value[: len(value) - step] * np.uint64(0xFF51AFD7ED558CCD + 2 * width) + value[step:]
            width += step
        return mix(value)

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchor, first and last window start, and gram hash, for texts that end at ``ends``."""
        if len(data) < self.length:
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
        value = self._grams(data)
        least = (value >> np.uint64(32) << np.uint64(32)) | np.arange(len(value), dtype=np.uint64)
        width, wanted = 1, self.length - self.gram + 1
        while width < wanted:
            step = min(width, wanted - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        start = np.arange(len(least))
        end = np.repeat(ends, np.diff(ends, prepend=0))[: len(least)]
        inside = np.flatnonzero(start + self.length <= end)
        if not len(inside):
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
        at = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.diff(at, prepend=-1))
        return at[new], inside[new], inside[np.append(new[1:], len(at)) - 1], value[at[new]]


def anchored(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Staged ``uid, doc_id, key, n_bytes, anchors``: each text's key and its anchors.

    An anchor has its place ``at``, the bytes ``left`` and ``right`` of it that its windows reach (together its
    piece), the hash ``gram`` of the bytes at it and the hash ``piece`` of the whole piece.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        anchors = Anchors(length, gram)

        def emit(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], []]
            counts = np.zeros(len(texts), np.int64)
            for first, last, base, data, ends in _windows(texts, length):
                at, low, high, value = anchors.of(np.frombuffer(data, np.uint8), ends)
                owner = np.searchsorted(ends, at, side="right")
                counts[first : last + 1] += np.bincount(owner, minlength=last + 1 - first)
                start = np.append(0, ends[:-1])[owner] if len(ends) > 1 else np.zeros(len(at), np.int64)
                columns[0].append(at - start + base)
                columns[1].append(at - low)
                columns[2].append(high + length - at)
                columns[3].append(value.view(np.int64))
                digest = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(low, high + length, strict=True)]
                columns[4].append(np.array(digest, np.uint64).view(np.int64))
            offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([[], *c]).astype(k.to_pandas_dtype()), k)
                                         if k != pa.int64() else pa.array(_joined(c), k))
                for c, k in zip(columns, kinds, strict=True)
            ]
            keys = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            sizes = pa.array([len(t) for t in texts], pa.int64())
            return pa.record_batch(
                [pa.array(ids, pa.int64()), keys, sizes, *lists],
                names=["doc_id", "key", "n_bytes", "at", "left", "right", "gram", "piece"],
            )

        def _joined(parts: list[np.ndarray]) -> np.ndarray:
            return np.concatenate([np.empty(0, np.int64), *parts])

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_py() or b"")
                held += len(texts[-1])
                if held >= 16 * _CHUNK:
                    yield emit(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield emit(ids, texts)

    schema = (
        "doc_id long, key binary, n_bytes long, at array<long>, left array<int>, right array<int>, "
        "gram array<long>, piece array<long>"
    )
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, schema)
    return stage(found.select(F.monotonically_increasing_id().alias("uid"), "*"), "anchors")


def _windows(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, bytes, np.ndarray]]:
    """Texts joined up to a chunk, and long ones cut where windows start: (first, last, base, bytes, ends)."""
    first = 0
    while first < len(texts):
        if len(texts[first]) > 2 * _CHUNK:
            text = texts[first]
            for base in range(0, len(text) - length + 1, _CHUNK):
                part = text[base : base + _CHUNK + length - 1]
                yield first, first, base, part, np.array([len(part)])
            first += 1
            continue
        last, size = first, len(texts[first])
        while last + 1 < len(texts) and size + len(texts[last + 1]) <= 2 * _CHUNK:
            last += 1
            size += len(texts[last])
        ends = np.cumsum([len(t) for t in texts[first : last + 1]])
        yield first, last, 0, b"".join(texts[first : last + 1]), ends
        first = last + 1


def repeated_windows(pieces: list[bytes], left: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For pieces aligned at their anchor, the byte ranges (from the anchor) of windows that another piece has too.

    Suffixes are sorted column by column, as collections of short strings are: from the last column to the first,
    each round inserts one symbol of every piece. The symbols in the order of the round before are the column's
    part of the collection's transform; a stable sort by them gives the new order, and common prefixes with
    the neighbour follow from the least ones between two equal symbols. A common prefix of
    ``length`` bytes marks the windows of both neighbours. Since equal windows are at the same distance from their anchors, only
    suffixes of one column have to be in order with each other.
    """
    m = len(pieces)
    sizes = np.array([len(p) for p in pieces])
    right = sizes - left
    low, width = int(-left.min(initial=0)), 0
    low = -int(left.max())
    width = int(right.max()) - low
    symbols = np.zeros((width, m), np.uint8)
    for i, piece in enumerate(pieces):
        begin = -int(left[i]) - low
        symbols[begin : begin + len(piece), i] = np.frombuffer(piece, np.uint8)
    enters: dict[int, np.ndarray] = {}
    leaves: dict[int, np.ndarray] = {}
    for at in np.unique(right):
        enters[int(at) - 1 - low] = np.flatnonzero(right == at)
    for at in np.unique(left):
        leaves[-int(at) - 1 - low] = np.flatnonzero(left == at)
    order, common = np.empty(0, np.int64), np.empty(0, np.int32)
    flags = np.zeros((width, m), bool)
    gone = np.zeros(m, bool)
    for column in range(width - 1, -1, -1):
        if column in leaves:
            gone[leaves[column]] = True
            stay = np.flatnonzero(~gone[order])
            if len(stay):
                common = np.minimum.reduceat(common[: stay[-1] + 1], np.append(0, stay[:-1] + 1))
            else:
                common = common[:0]
            order = order[stay]
        if column in enters:
            new = enters[column]
            order = np.concatenate((new, order))
            common = np.concatenate((np.zeros(len(new), np.int32), common))
            if len(order) > len(new):
                common[len(new)] = 0
        if not len(order):
            continue
        symbol = symbols[column, order]
        moved = np.argsort(symbol, kind="stable")
        same = symbol[moved[1:]] == symbol[moved[:-1]]
        after = np.zeros(len(order), np.int32)
        if same.any():
            after[1:][same] = _least_between(common, moved[:-1][same] + 1, moved[1:][same]) + 1
        order, common = order[moved], after
        near = np.flatnonzero(common >= length)
        flags[column, order[near]] = True
        flags[column, order[near - 1]] = True
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    edge = np.diff(flags.astype(np.int8), axis=0, prepend=0, append=0)
    for i in np.flatnonzero(flags.any(axis=0)):
        begins, stops = np.flatnonzero(edge[:, i] == 1), np.flatnonzero(edge[:, i] == -1)
        ranges[i] = [(int(a) + low, int(b) - 1 + low + length) for a, b in zip(begins, stops, strict=True)]
    return ranges


def _least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least value from first to last, both included, by minima over powers of two."""
    span = last - first + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    table, width = values, 1
    for k in range(int(level.max()) + 1):
        if k:
            table = np.minimum(table[: len(table) - width], table[width:])
            width *= 2
        rows = np.flatnonzero(level == k)
        if len(rows):
            out[rows] = np.minimum(table[first[rows]], table[last[rows] - width + 1])
    return out


def _sorted_groups(pieces: DataFrame, length: int) -> DataFrame:
    """``gram, piece, ranges`` for anchors whose different pieces fit one task."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            found = repeated_windows([r[3] for r in rows], np.array([r[2] for r in rows]), length)
            keep = [(r[0], r[1], [{"s": s, "e": e} for s, e in x]) for r, x in zip(rows, found, strict=True) if x]
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            columns = [pa.array([k[i] for k in keep], t) for i, t in enumerate((pa.int64(), pa.int64(), kind))]
            return pa.record_batch(columns, names=["gram", "piece", "ranges"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if len(held) >= _BATCH_PIECES and row[0] != held[-1][0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return (
        pieces.select("gram", "piece", "left", "bytes")
        .repartition("gram")
        .sortWithinPartitions("gram")
        .mapInArrow(sort, f"gram long, piece long, ranges {_SPAN}")
    )


def _counted_windows(pieces: DataFrame, length: int) -> DataFrame:
    """The same for anchors with any number of pieces: every window's digest is a row, counted by Spark."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for gram, piece, left, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                n = len(data) - length + 1
                found = [xxhash.xxh3_128_digest(data[k : k + length]) for k in range(n)]
                columns = [
                    pa.array(np.full(n, gram)),
                    pa.array(np.full(n, piece)),
                    pa.array(np.arange(n) - left),
                    pa.array(found, pa.binary()),
                ]
                yield pa.record_batch(columns, names=["gram", "piece", "s", "digest"])

    rows = pieces.select("gram", "piece", "left", "bytes").mapInArrow(
        digests, "gram long, piece long, s long, digest binary"
    )
    twice = rows.groupBy("gram", "s", "digest").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    spans = F.transform(F.collect_list("s"), lambda s: F.struct(s.alias("s"), (s + length).alias("e")))
    return rows.join(twice, ["gram", "s", "digest"]).groupBy("gram", "piece").agg(spans.alias("ranges"))


def repeated_spans(
    docs: DataFrame, rows: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP
) -> tuple[DataFrame, DataFrame]:
    """For ``rows`` from :func:`anchored`: removed spans by text, and the texts with repeated anchors.

    Spans: ``key, n_removed, n_spans, spans``; texts: ``key, text`` (staged, one row for each key).
    """
    anchors = rows.select(
        "uid", F.explode(F.arrays_zip("at", "left", "right", "gram", "piece")).alias("x")
    ).select("uid", "x.*")
    # A table of its own: the join then deals out a very frequent gram's rows over several tasks.
    grams = stage(anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    shared = stage(anchors.join(grams, "gram"), "shared")
    one = rows.groupBy("key").agg(F.min("uid").alias("uid"))
    needed = stage(one.join(shared.select("uid").distinct(), "uid").select("key"), "needed")
    keyed = docs.select(
        content_key(F.col("text").cast("string")).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    texts = stage(
        split_by_key(keyed, needed, "key")[0]
        .join(needed, "key")
        .groupBy("key")
        .agg(F.first("text").alias("text")),
        "texts",
    )
    pieces = stage(
        shared.groupBy("gram", "piece").agg(
            F.count("*").alias("n"),
            F.first("uid").alias("uid"),
            F.first("at").alias("at"),
            F.first("left").alias("left"),
            F.first("right").alias("right"),
        ),
        "pieces",
    )
    mixed = pieces.groupBy("gram").agg(F.count("*").alias("different")).where("different > 1")
    places = (
        pieces.join(mixed, "gram")
        .join(rows.select("uid", "key"), "uid")
        .groupBy("key")
        .agg(F.collect_list(F.struct("gram", "piece", "different", "at", "left", "right")).alias("places"))
    )
    cut = stage(
        places.join(texts.select("key", F.col("text").cast("binary").alias("body")), "key")
        .select("body", F.explode("places").alias("p"))
        .select(
            "p.gram",
            "p.piece",
            "p.different",
            "p.left",
            F.expr("substring(body, int(p.at - p.left + 1), p.left + p.right)").alias("bytes"),
        ),
        "cut",
    )
    ranges = _sorted_groups(cut.where(F.col("different") <= max_group), length).unionByName(
        _counted_windows(cut.where(F.col("different") > max_group), length)
    )
    whole = F.array(F.struct((-F.col("left")).cast("long").alias("s"), F.col("right").cast("long").alias("e")))
    covered = (
        shared.join(one, "uid")
        .join(pieces.select("gram", "piece", "n"), ["gram", "piece"])
        .join(ranges, ["gram", "piece"], "left")
        .select("key", "at", F.explode(F.when(F.col("n") > 1, whole).otherwise(F.col("ranges"))).alias("r"))
        .select("key", (F.col("at") + F.col("r.s")).alias("s"), (F.col("at") + F.col("r.e")).alias("e"))
    )
    before = Window.partitionBy("key").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("key").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        covered.withColumn("reach", F.max("e").over(before))
        .withColumn("run", F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(upto))
        .groupBy("key", "run")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
    )
    spans = stage(
        runs.groupBy("key").agg(
            F.sum(F.col("e") - F.col("s")).alias("n_removed"),
            F.count("*").alias("n_spans"),
            F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"),
        ),
        "spans",
    )
    for used in (grams, shared, needed, pieces, cut):
        drop_stage(used)
    return spans, texts


def _without(text: bytes, spans: list[dict]) -> bytes:
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : span["s"]])
        at = span["e"]
    return b"".join([*kept, text[at:]])


def cut_report(docs: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, text``.

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another. Null
    and empty texts have no bytes; a text shorter than ``length`` keeps all of its bytes. Repeated rows, also with one
    doc_id, are documents of their own. ``text`` is what is left, without the bytes of characters that are cut in two, which the digest
    has; a null text stays null. Other columns are ignored. An empty table gives an empty result.
    """
    rows = anchored(docs, length)
    spans, texts = repeated_spans(docs, rows, length, max_group)
    drop_stage(rows)
    drop_stage(texts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            kept = [_without(t.as_py(), s.as_py()) for t, s in zip(texts, batch.column("spans"), strict=True)]
            found = {
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
                "text": pa.array([t.decode(errors="ignore") for t in kept], pa.string()),
            }
            names = [c for c in batch.schema.names if c != "spans"]
            yield pa.record_batch([found[c] if c in found else batch.column(c) for c in names], names=names)

    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content_key(text).alias("key"), text.alias("text"))
    likely, surely = split_by_key(keyed, spans.select("key"), "key")
    joined = likely.join(spans, "key", "left")
    facts = (
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.lower(F.hex("key")).alias("kept_sha256"),
        "text",
    )
    changed = joined.where("spans is not null").select(*facts, "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    )
    whole = joined.where("spans is null").select(*facts)
    apart = surely.withColumns({c: F.lit(None).cast("long") for c in ("n_removed", "n_spans")}).select(*facts)
    return changed.unionByName(whole).unionByName(apart)


def repeat_report(docs: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of :func:`cut_report`."""
    return cut_report(docs, length, max_group).drop("text")


def remove_repeats(docs: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """``docs`` with the removed bytes cut out of ``text``, and ``n_chars``, if there is one, counted anew.

    Bytes of a character that is cut in two are dropped with it, so that the text stays valid. All rows stay, also those that
    lose their whole text; a null text stays null, and a text without repeats stays as it is, with its n_chars.
    """
    rows = anchored(docs, length)
    spans, texts = repeated_spans(docs, rows, length, max_group)
    drop_stage(rows)
    drop_stage(texts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [
                t.as_py() if s.as_py() is None else _without(t.as_py().encode(), s.as_py()).decode(errors="ignore")
                for t, s in zip(batch.column("body"), batch.column("spans"), strict=True)
            ]
            yield pa.record_batch([batch.column("row"), pa.array(kept, pa.string())], names=["row", "body"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    body = F.col("text").cast("string")
    likely, surely = split_by_key(docs.select(content_key(body).alias("key"), row, body.alias("body")), spans.select("key"), "key")
    joined = likely.join(spans.select("key", "spans"), "key", "left")
    changed = joined.where("spans is not null").select("row", "body", "spans")
    whole = joined.where("spans is null").select("row", "body").unionByName(surely.select("row", "body"))
    names = {c: F.col("body") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns}
    counted = dict(names)
    if "n_chars" in docs.columns:
        counted["n_chars"] = F.length("body").cast(docs.schema["n_chars"].dataType)
    schema = whole.schema
    return (
        changed.mapInArrow(cut, schema)
        .select(*[c.alias(n) for n, c in counted.items()])
        .unionByName(whole.select(*[c.alias(n) for n, c in names.items()]))
    )
