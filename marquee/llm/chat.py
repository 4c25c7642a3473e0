"""Chat formatting at token level: segments are encoded alone, and reserved ids mark turns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.shared import stage
from marquee.llm.vocabularies import ranks_from_tiktoken

# The control strings of the template, and of common ones whose markers texts may hold.
START, ROLE, BODY, STOP = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (START, ROLE, BODY, STOP)
ESCAPE = "\\"
LEARNED = "assistant"

_CONTROL = "|".join(re.escape(c) for c in CONTROL)


def escape(text: Column) -> Column:
    """Put a backslash before each control string, and double the backslashes before it and at the end of the text.

    A control string after an even number of backslashes is then always one of the template.
    """
    inside = F.regexp_replace(text, rf"(\\*)({_CONTROL})", r"$1$1\\$2")
    return F.regexp_replace(inside, r"(?<!\\)(\\+)\z", "$1$1")


def unescape(text: str) -> str:
    text = re.sub(rf"(\\+)({_CONTROL})", lambda m: ESCAPE * (len(m[1]) // 2) + m[2], text)
    return re.sub(r"(\\+)\Z", lambda m: ESCAPE * (len(m[1]) // 2), text)


def reserved(n_ranks: int) -> dict[str, int]:
    """Ids of the control strings: the first ones that no text can get."""
    return {c: n_ranks + k for k, c in enumerate(CONTROL)}


def format_turns(conversations: DataFrame, vocabulary: str, pattern: str, learned: str = LEARNED) -> DataFrame:
    """One staged row for each turn: ``conv_id, seq, ids, start, loss_start, loss_end``.

    A conversation is ``<s>`` and, for each turn, ``[INST]`` role ``[/INST]`` text ``</s>``, where the marks are reserved ids and
    role and text are encoded separately with control strings escaped. ``start`` is the number of ids of the
    conversation before the turn, and the loss mask covers the ids from ``loss_start`` to ``loss_end`` (excluded), counted from
    the conversation's start: the text of a turn whose role is ``learned`` and the ``</s>`` that ends it. Both come from prefix sums.

    Null role and text are empty. Turns are in the order of ``turn`` (nulls first); of repeated turns by role, then text. Rows without conv_id
    form one conversation. Other columns are ignored, and an empty table gives an empty result.
    """
    ranks = ranks_from_tiktoken(vocabulary)
    marks = reserved(max(ranks.values(), default=-1) + 1)
    known = conversations.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known.value, special_tokens={})
        for batch in batches:
            columns = list(batch.columns)
            for name in ("role", "text"):
                at = batch.schema.names.index(name)
                found = [encoder.encode_ordinary(x.as_py()) for x in batch.column(name)]
                columns[at] = pa.array(found, pa.list_(pa.int32()))
            yield pa.record_batch(columns, names=batch.schema.names)

    turns = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "raw_role", "raw_text")
    turns = turns.select(
        "conv_id",
        "turn",
        (F.col("role") == learned).alias("learn"),
        F.sha2("role", 256).alias("raw_role"),
        F.sha2("text", 256).alias("raw_text"),
        escape(F.col("role")).alias("role"),
        escape(F.col("text")).alias("text"),
    )
    coded = turns.mapInArrow(
        encode,
        "conv_id long, turn long, learn boolean, raw_role string, raw_text string, role array<int>, text array<int>",
    )
    mark = lambda c: F.array(F.lit(marks[c]))
    coded = coded.withColumn("seq", F.row_number().over(order) - 1)
    coded = coded.withColumn("lead", F.when(F.col("seq") == 0, mark(START)).otherwise(F.array().cast("array<int>")))
    coded = coded.withColumn(
        "ids", F.concat("lead", mark(ROLE), "role", mark(BODY), "text", mark(STOP))
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).cast("long")
    coded = coded.withColumn("start", start)
    body = F.col("start") + F.size("lead") + 2 + F.size("role")
    return stage(
        coded.select(
            "conv_id",
            "seq",
            "ids",
            "start",
            F.when(F.col("learn"), body).alias("loss_start"),
            F.when(F.col("learn"), F.col("start") + F.size("ids")).alias("loss_end"),
        ),
        "turns",
    )


def read_back(formatted: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of each conversation, from its ids and its loss mask alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``: role, line feed, text and line feed of
    all turns; all text under the mask; and the length of the whole as a string. A task takes the
    turns of its conversations one after the other, so that a conversation of any length needs the memory of one turn.
    """
    ranks = ranks_from_tiktoken(vocabulary)
    marks = reserved(max(ranks.values(), default=-1) + 1)
    pieces = {number: token for token, number in ranks.items()}
    known = formatted.sparkSession.sparkContext.broadcast(pieces)

    class Reader:
        """What has been read of one conversation."""

        def __init__(self, conv_id: int | None) -> None:
            self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, ids: np.ndarray, start: int, loss_start: int | None, loss_end: int | None) -> None:
            opened = {number: text for text, number in marks.items()}
            places = [k for k, x in enumerate(ids) if int(x) in opened]
            self.chars += sum(len(opened[int(ids[k])]) for k in places)
            text = {}
            for a, b in zip(places, [*places[1:], len(ids)], strict=True):
                kind, inside = opened[int(ids[a])], ids[a + 1 : b]
                if kind in (ROLE, BODY):
                    escaped = b"".join(known.value[int(x)] for x in inside).decode()
                    self.chars += len(escaped)
                    text[kind] = unescape(escaped)
                    first = start + a + 1
                    if loss_start is not None and len(inside) and loss_start <= first and first + len(inside) <= loss_end:
                        self.loss_chars += len(text[kind])
                        self.loss.update(text[kind].encode())
            self.turns += 1
            self.all.update(f"{text[ROLE]}\n{text[BODY]}\n".encode())

        def row(self) -> tuple:
            return (
                self.conv_id,
                self.turns,
                self.all.hexdigest(),
                self.loss_chars,
                self.loss.hexdigest(),
                self.chars,
            )

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        reader = None

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)]
            done.clear()
            return pa.record_batch(columns, names=names)

        for batch in batches:
            conv, ids, start, first, last = (batch.column(c) for c in ("conv_id", "ids", "start", "loss_start", "loss_end"))
            for k in range(batch.num_rows):
                conv_id = conv[k].as_py()
                if reader is None or reader.conv_id != conv_id:
                    if reader is not None:
                        done.append(reader.row())
                    reader = Reader(conv_id)
                reader.add(ids[k].values.to_numpy(), start[k].as_py(), first[k].as_py(), last[k].as_py())
            if len(done) >= 4096:
                yield flush()
        if reader is not None:
            done.append(reader.row())
        if done:
            yield flush()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return (
        formatted.select("conv_id", "seq", "ids", "start", "loss_start", "loss_end")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "seq")
        .mapInArrow(read, schema)
    )
