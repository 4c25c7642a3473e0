"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.shared import drop_stage, stage

LIMIT = 1 << 20
#: Hash bits that one pass adds to the directory.
STEP = 12
HASH_BITS = 64


def _bits(digest: Column) -> Column:
    """The first 64 bits of a hexadecimal digest, as characters 0 and 1."""
    return F.lpad(F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _digest() -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat(name, F.lit(":"), _text()))


def hashed_rows(docs: DataFrame) -> DataFrame:
    """Staged ``doc_id, n_bytes, bits``: 64 bits of the MD5 of doc_id and text, then 64 that differ between equal rows."""
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.octet_length(_text()).cast("long").alias("n_bytes"),
        _digest().alias("digest"),
        F.md5(F.monotonically_increasing_id().cast("string")).alias("salt"),
    )
    bits = F.concat(_bits(F.col("digest")), _bits(F.col("salt")))
    return stage(rows.select("doc_id", "n_bytes", bits.alias("bits")), "rows")


def split_once(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Staged directory entries by ``cell``, the first ``high`` bits: the first prefix longer than ``low`` that fits.

    A prefix fits if its bytes do, or if it has one row. Entries without a shard have to split further.
    """
    cells = stage(
        rows.groupBy(F.substring("bits", 1, high).alias("cell")).agg(
            F.count("*").alias("n"), F.sum("n_bytes").alias("b")
        ),
        "cells",
    )
    depths = F.sequence(F.lit(low + 1 if low else 0), F.lit(high))
    prefixes = cells.select("cell", "n", "b", F.explode(depths).alias("depth")).withColumn(
        "shard", F.expr("substring(cell, 1, depth)")
    )
    sums = (
        prefixes.groupBy("depth", "shard")
        .agg(F.sum("n").alias("shard_docs"), F.sum("b").alias("shard_bytes"))
        .where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == 2 * HASH_BITS))
    )
    fitting = (
        prefixes.select("cell", "depth", "shard")
        .join(sums, ["depth", "shard"])
        .groupBy("cell")
        .agg(F.min(F.struct("depth", "shard", "shard_docs", "shard_bytes")).alias("found"))
    )
    entries = stage(cells.select("cell").join(fitting, "cell", "left").select("cell", "found.*"), "directory")
    drop_stage(cells)
    return entries


def shard_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, shard, depth, shard_docs, shard_bytes`` for every row of ``docs``.

    The directory starts with one shard for all rows; a shard with more bytes than ``limit`` splits on the next bit of
    the hash, so that a shard is a prefix of ``depth`` bits. A text longer than the limit ends up alone in its shard.
    Null texts are empty, and a null doc_id hashes as an empty string. Rows with equal doc_id and text share
    all 64 hash bits; only where those rows alone exceed the limit do further bits, of their row numbers, split them.
    Other columns are ignored; an empty table gives an empty result.

    A pass sums up the bytes of rows without a shard by their next 12 bits, and all shorter prefixes from those sums. Rows get
    their shard by a join on the cell, and only rows of oversized buckets go on.
    """
    left, low, done = hashed_rows(docs), 0, []
    while True:
        high = min(low + STEP, 2 * HASH_BITS)
        entries = split_once(left, low, high, limit)
        cell = F.substring("bits", 1, high)
        keyed = left.withColumn("cell", cell)
        done.append(keyed.join(entries.where("shard is not null"), "cell").drop("cell", "bits"))
        over = entries.where("shard is null").select("cell")
        if high == 2 * HASH_BITS or over.isEmpty():
            break
        left, low = stage(keyed.join(over, "cell", "left_semi").drop("cell"), "rows"), high
    return reduce(DataFrame.unionByName, done).select(
        "doc_id", "n_bytes", "shard", "depth", "shard_docs", "shard_bytes"
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``number``, from 1 within equal ``bits``: the place in one of 64 parts, after all parts before."""
    held = stage(rows.withColumn("part", F.monotonically_increasing_id() % 64), "rows")
    before = Window.partitionBy("bits").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy("bits", "part").count()
    parts = parts.select("bits", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bits", "part").orderBy(F.lit(1)))
    placed = held.withColumn("place", place).join(parts, ["bits", "part"])
    return placed.withColumn("number", F.col("before") + F.col("place")).drop("part", "place", "before")


def write_shards(docs: DataFrame, shards: DataFrame, path: str) -> None:
    """Write whole rows into one folder for each shard, every row once; ``shards`` is the result for these ``docs``.

    A row's shard is the one that begins its 64 hash bits. Equal rows that were split beyond those
    bits are dealt out by number: as many go to each shard as were counted there.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _bits(_digest()).alias("bits"))
    shallow = shards.where(F.col("depth") <= HASH_BITS).select("depth", "shard").distinct()
    depths = F.array(*[F.lit(r["depth"]) for r in shallow.select("depth").distinct().collect()]).cast("array<int>")
    prefixes = rows.select("bits").distinct().withColumn("depth", F.explode(depths))
    prefixes = prefixes.withColumn("shard", F.expr("substring(bits, 1, depth)"))
    whole = rows.join(prefixes.join(shallow, ["depth", "shard"]).select("bits", "shard"), "bits").select("row.*", "shard")
    deep = shards.where(F.col("depth") > HASH_BITS)
    slots = _numbered(deep.select(F.substring("shard", 1, HASH_BITS).alias("bits"), "shard"))
    split = _numbered(rows.join(slots.select("bits").distinct(), "bits", "left_semi"))
    split = split.join(slots, ["bits", "number"]).select("row.*", "shard")
    whole.unionByName(split).repartition("shard").write.partitionBy("shard").parquet(path)
