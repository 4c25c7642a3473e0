"""CSV files with line breaks inside quotes, read by as many tasks as they have byte ranges.

Whether a line break ends a record depends on all quotes before it. Each byte range counts its quotes and the lines that would begin
a record for both cases, outside and inside of quotes; a scan over the ranges' counts settles the case of each. Records
then go to Spark's own parser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.session import stage

_LINE = "file string, block long, line long, quotes long, odd int, outside long, inside long, value string"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the parity of the quotes before them in their range, and the record starts so far for both cases."""
    held, line, quotes, starts = None, 0, 0, [0, 0]
    for batch in batches:
        key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        number = pc.count_substring(batch.column(2), '"').to_numpy().astype(np.int64)
        cuts = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if low == high:
                continue
            if key[low] != held:
                held, line, quotes, starts = key[low], 0, 0, [0, 0]
            own = number[low:high]
            odd = (quotes + np.cumsum(own) - own) % 2
            counts = [starts[case] + np.cumsum(odd == case) for case in (0, 1)]
            part = batch.slice(low, high - low)
            columns = [
                part.column(0), part.column(1), pa.array(line + np.arange(high - low)), pa.array(own),
                pa.array(odd, pa.int32()), pa.array(counts[0]), pa.array(counts[1]), part.column(2),
            ]
            yield pa.record_batch(columns, names=["file", "block", "line", "quotes", "odd", "outside", "inside", "value"])
            line, quotes, starts = line + high - low, quotes + int(own.sum()), [int(c[-1]) for c in counts]


def records(spark: SparkSession, path: str) -> DataFrame:
    """``number, first, record``: the records of all files under ``path`` in order, and whether one is its file's first.

    Quotes inside of quotes are doubled. Only lines of records with several lines are moved.
    """
    lines = (
        spark.read.option("lineSep", "\n").text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
        .mapInArrow(_counted, _LINE)
    )
    ranges = lines.groupBy("file", "block").agg(
        (F.sum("quotes") % 2).alias("parity"), F.max("outside").alias("outside"), F.max("inside").alias("inside")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cased = ranges.withColumn("case", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2)
    starts = F.when(F.col("case") == 0, F.col("outside")).otherwise(F.col("inside"))
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each byte range
    scanned = stage(
        cased.select("file", "block", "case", F.coalesce(F.sum(starts).over(earlier), F.lit(0)).alias("earlier"),
                     (F.min("block").over(Window.partitionBy("file")) == F.col("block")).alias("leading")),
        "ranges",
    )
    count = F.when(F.col("case") == 0, F.col("outside")).otherwise(F.col("inside"))
    placed = lines.join(scanned, ["file", "block"]).select(
        (F.col("earlier") + count).alias("number"),
        (F.col("leading") & (count == 1)).alias("first"),
        ((F.col("odd") + F.col("case")) % 2 == 0).alias("starts"),
        (F.col("quotes") % 2 == 0).alias("even"),
        "block", "line", "value",
    )
    whole = F.col("starts") & F.col("even")
    one = placed.where(whole).select("number", "first", F.col("value").alias("record"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    more = placed.where(~whole).groupBy("number").agg(
        F.max("first").alias("first"), F.array_join(F.transform(pieces, lambda x: x["value"]), "\n").alias("record")
    )
    return one.unionByName(more).withColumn("record", F.regexp_replace("record", "\r$", "")).where("record != ''")


def read_quoted(spark: SparkSession, path: str, number: str | None = None) -> DataFrame:
    """All-string rows by the header's names; ``number`` names a column that ascends with the order of rows in the files."""
    names = spark.read.option("header", True).option("escape", '"').csv(path).columns
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = records(spark, path).where(~F.col("first")).select("number", F.from_csv("record", schema, {"escape": '"'}).alias("row"))
    return rows.select(*([F.col("number").alias(number)] if number else []), "row.*")
