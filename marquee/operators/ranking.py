"""Ranked lists: the one top-k form used by every operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import stage


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows per key under a total order, numbered from 1.

    A literal bound on ``row_number`` lets Spark cut each group to ``n`` rows before
    the shuffle, so a key holding most of the rows never reaches one task whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def numbered(rows: DataFrame, order: Sequence[Column], name: str, number: str) -> DataFrame:
    """``rows`` with their place in the sorted table, from 0.

    The table is sorted by ranges and staged; a row's number is its place in its range after the rows of all ranges before, so
    that only one row for each range is ever in one task.
    """
    placed = rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = stage(placed, name).withColumn("_range", F.shiftright("_place", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_range").count().select(
        "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    place = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return placed.join(ranges, "_range").select(*rows.columns, place.alias(number))
