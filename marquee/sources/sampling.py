"""Reproducible samples and splits of an exact size, without a global sort.

Rows are ordered by the MD5 of their key, so the order is the same on any cluster
and for any partitioning. The first four hex digits cut that order into 65,536
buckets; counting the buckets tells where a position falls, and only rows of one
bucket are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COPIES_AT_ONCE = 10_000


def _hash(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)).cast("binary"))


def with_copy_number(df: DataFrame) -> DataFrame:
    """Number identical rows 1, 2, ... in ``copy_no``, so that all columns together are unique.

    Copies are counted first and written out again in bounded pieces, which keeps a
    row repeated very often from landing in one task.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("copies"))
    pieces = counted.withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / _COPIES_AT_ONCE)))
    )
    first = F.col("piece") * _COPIES_AT_ONCE + 1
    last = F.least("copies", first + (_COPIES_AT_ONCE - 1))
    return pieces.withColumn("copy_no", F.explode(F.sequence(first, last))).drop("copies", "piece")


def _buckets(hashed: DataFrame) -> DataFrame:
    """(bucket, upto): rows up to and including each bucket; at most 65,536 rows."""
    counts = hashed.groupBy("bucket").agg(F.count("*").alias("n"))
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("bucket", "n", F.sum("n").over(running).alias("upto"))


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``min(n, count)`` rows, uniformly and without replacement; ``keys`` must be unique."""
    hashed = df.withColumn("_hash", _hash(keys, seed)).withColumn("bucket", F.substring("_hash", 1, 4))
    buckets = _buckets(hashed)
    edge = buckets.where(F.col("upto") >= n).agg(F.min("bucket").alias("b")).scalar()
    room = n - F.coalesce(
        buckets.where(F.col("upto") < n).agg(F.max("upto").alias("u")).scalar(), F.lit(0)
    )
    whole = hashed.where(edge.isNull() | (F.col("bucket") < edge))
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("_hash", *keys))
    part = hashed.where(F.col("bucket") == edge).withColumn("_at", at).where(F.col("_at") <= room)
    return whole.unionByName(part.drop("_at")).drop("_hash", "bucket")


def shuffled_position(df: DataFrame, keys: Sequence[str], seed: int = 42, name: str = "position") -> DataFrame:
    """Number all rows 1..count in hash order."""
    hashed = df.withColumn("_hash", _hash(keys, seed)).withColumn("bucket", F.substring("_hash", 1, 4))
    before = _buckets(hashed).select("bucket", (F.col("upto") - F.col("n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("_hash", *keys))
    return (
        hashed.withColumn("_at", at)
        .join(before, "bucket")
        .withColumn(name, F.col("_before") + F.col("_at"))
        .drop("_hash", "bucket", "_at", "_before")
    )


def train_validation_split(
    df: DataFrame, keys: Sequence[str], n_train: int = 5000, n_validation: int = 1000, seed: int = 42
) -> DataFrame:
    """Rows of a seeded shuffle with ``part`` = 'train' or 'validation'; the rest is dropped."""
    placed = shuffled_position(df, keys, seed, "_position")
    return (
        placed.withColumn("part", F.when(F.col("_position") <= n_train, "train").otherwise("validation"))
        .where(F.col("_position") <= n_train + n_validation)
        .drop("_position")
    )
