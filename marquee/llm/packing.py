"""Best-fit packing of token sequences after a reduction by dominance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.shared import stage
from marquee.llm.vocabularies import added_tokens, ranks_from_json

CAPACITY = 2048
END_OF_TEXT = 0
_BATCH_BYTES = 8 << 20
_SHIFT = 1 << 40

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(
    docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, end: int = END_OF_TEXT
) -> DataFrame:
    """Every whole text as pieces of at most ``capacity`` ids, staged: ``uid, doc_id, piece, start, length, ids``.

    A document is the ids of its text (null: empty; added tokens of the vocabulary are matched inside it) and then ``end``. Only a longer one is cut: its first piece has
    what is left over, all others are full. ``ids`` is a binary of little-endian unsigned 32-bit
    numbers. Repeated rows, also with one doc_id (null included), are documents of their own: ``uid`` tells them
    apart. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(ranks_from_json(vocabulary))
    added = added_tokens(vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens=added)
        columns: list[list] = [[], [], [], [], []]
        held = 0

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            for c in columns:
                c.clear()
            return pa.record_batch(arrays, names=["doc_id", "piece", "start", "length", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id = doc_id.as_py()
                ids = np.asarray([*encoder.encode(text.as_py() or "", allowed_special="all"), end], dtype="<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    piece = ids[a:b].tobytes()
                    held += len(piece)
                    for c, value in zip(columns, (doc_id, k, a, b - a, piece), strict=True):
                        c.append(value)
                if held >= _BATCH_BYTES:
                    held = 0
                    yield flush()
        if columns[0]:
            yield flush()

    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE_SCHEMA)
    return stage(pieces.select(F.monotonically_increasing_id().alias("uid"), "*"), "pieces")


@dataclass
class Slot:
    """Pieces of one length, by their rank from ``first``, at ``offset`` of ``count`` successive sequences."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int


class _Plan:
    """What is left of every length, and the slots given out so far."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = n
        self.given = [0] * (capacity + 1)
        self.slots: list[Slot] = []
        self.sequences = 0

    def take(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.slots.append(Slot(length, self.given[length], count, sequence, offset))
        self.given[length] += count
        self.left[length] -= count

    def close(self, lengths: list[int], count: int) -> None:
        """Fix ``count`` sequences of these lengths for good."""
        offset = 0
        for length in lengths:
            self.take(length, count, self.sequences, offset)
            offset += length
        self.sequences += count

    def largest(self, limit: int, without: int) -> int:
        """The largest length up to ``limit`` that is left beside one piece of length ``without``; 0: none."""
        return next((w for w in range(min(limit, self.capacity), 0, -1) if self.left[w] - (w == without) > 0), 0)

    def smallest(self, without: int, how_many: int = 3) -> list[int]:
        found: list[int] = []
        for w in range(1, self.capacity + 1):
            found += [w] * min(how_many - len(found), max(0, self.left[w] - (w == without)))
            if len(found) == how_many:
                break
        return found

    def best_pair(self, room: int, without: int) -> tuple[int, int]:
        """The two pieces with the largest sum up to ``room``, larger first; (0, 0): none."""
        rest = [w for w in range(1, min(room, self.capacity) + 1) if self.left[w] - (w == without) > 0]
        best, pair, low, high = 0, (0, 0), 0, len(rest) - 1
        while low <= high:
            a, b = rest[high], rest[low]
            if a + b > room:
                high -= 1
                continue
            if (low < high or self.left[a] - (a == without) > 1) and a + b >= best:
                best, pair = a + b, (a, b)
            low += 1
        return pair

    def smallest_between(self, a: int, b: int, without: int) -> list[int]:
        """Up to two smallest pieces from length b to a, one of each of the two left aside."""
        found: list[int] = []
        for w in range(b, a + 1):
            spare = self.left[w] - (w == without) - (w == a) - (w == b)
            found += [w] * min(2 - len(found), max(0, spare))
            if len(found) == 2:
                break
        return found


def _dominating(plan: _Plan, w: int) -> list[int] | None:
    """A set with a piece of length w that dominates all others with it, if one can be proven."""
    room = plan.capacity - w
    small = plan.smallest(w)
    fits = sum(sum(small[: k + 1]) <= room for k in range(len(small)))
    if fits == 0:
        return [w]
    single = plan.largest(room, w)
    if fits == 1 or single == room:
        return [w, single]
    if fits == 2:
        a, b = plan.best_pair(room, w)
        if single >= a + b:
            return [w, single]
        if single == a:
            between = plan.smallest_between(a, b, w)
            if len(between) < 2 or sum(between) > room:
                return [w, a, b]
    return None


def reduce_by_dominance(plan: _Plan) -> None:
    """Fix sets of at most three pieces that dominate every other set with their largest piece.

    No packing is lost: some best packing has each fixed set. A set is fixed as often as pieces of its
    lengths are left, since taking pieces away keeps the conditions true.
    """
    changed = True
    while changed:
        changed = False
        for w in range(plan.capacity, 0, -1):
            while plan.left[w] and (chosen := _dominating(plan, w)):
                plan.close(chosen, min(plan.left[x] // chosen.count(x) for x in set(chosen)))
                changed = True


def best_fit(plan: _Plan) -> None:
    """Put what is left, longest first, where the least room remains; open a sequence where nothing fits."""
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(plan.capacity + 1)]  # by room: (sequence, count)
    for w in range(plan.capacity, 0, -1):
        while n := plan.left[w]:
            room = next((r for r in range(w, plan.capacity) if rooms[r]), plan.capacity)
            each = min(room // w, n)
            if room == plan.capacity:
                sequence, wide = plan.sequences, n // each
                plan.sequences += wide
            else:
                sequence, there = rooms[room].pop()
                wide = min(there, n // each)
                if wide < there:
                    rooms[room].append((sequence + wide, there - wide))
            for k in range(each):
                plan.take(w, wide, sequence, plan.capacity - room + k * w)
            if room - each * w:
                rooms[room - each * w].append((sequence, wide))


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Slot], int]:
    """Slots for ``counts`` pieces by length, and the number of sequences.

    The work and the number of slots depend on the capacity, not on how many pieces there are.
    """
    plan = _Plan(counts, capacity)
    reduce_by_dominance(plan)
    best_fit(plan)
    return plan.slots, plan.sequences


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces(uid, length, ...)`` without ids, and ``sequence_id, offset`` of each.

    Only the counts by length (at most ``capacity`` rows) and by partition reach the driver. Pieces are numbered within
    their length by a range partitioning on (length, uid), so that a very frequent length is split.
    An empty table gives an empty result.
    """
    slim = pieces.drop("ids")
    counts = {r["length"]: r["n"] for r in slim.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan_sequences(counts, capacity)
    slots.sort(key=lambda s: (s.length, s.first))
    keys = np.array([s.length * _SHIFT + s.first for s in slots], np.int64)
    sequences = np.array([s.sequence for s in slots], np.int64)
    offsets = np.array([s.offset for s in slots], np.int64)

    ordered = stage(
        slim.repartitionByRange("length", "uid")
        .sortWithinPartitions("length", "uid")
        .withColumn("place", F.monotonically_increasing_id()),
        "ordered",
    )
    sizes = {
        r["part"]: r["n"]
        for r in ordered.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).collect()
    }
    before = np.zeros(max(sizes, default=0) + 1, np.int64)
    running = 0
    for part in sorted(sizes):
        before[part] = running
        running += sizes[part]
    starts = np.zeros(capacity + 1, np.int64)
    running = 0
    for length in sorted(counts):
        starts[length] = running
        running += counts[length]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.column("place").to_numpy()
            length = batch.column("length").to_numpy()
            rank = before[where >> 33] + (where & ((1 << 33) - 1)) - starts[length]
            key = length * _SHIFT + rank
            slot = np.searchsorted(keys, key, side="right") - 1
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "place"]
            names = [n for n in batch.schema.names if n != "place"]
            columns += [pa.array(sequences[slot] + key - keys[slot]), pa.array(offsets[slot])]
            yield pa.record_batch(columns, names=[*names, "sequence_id", "offset"])

    schema = slim.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ordered.mapInArrow(assign, schema)


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """The packed ids: ``sequence_id, ids`` (binary), each at most one sequence long."""
    parts = pieces.select("uid", "ids").join(places.select("uid", "sequence_id", "offset"), "uid")
    joined = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return parts.groupBy("sequence_id").agg(
        F.unhex(F.array_join(F.transform(joined, lambda x: x["ids"]), "")).alias("ids")
    )


def pack(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document: where it lies, and the CRC-32 of its ids."""
    pieces = token_pieces(docs, vocabulary, pattern, capacity)
    places = place(pieces.withColumn("ids_crc32", F.crc32("ids")), capacity)
    return places.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
