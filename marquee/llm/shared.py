"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.session import drop_stage, stage

__all__ = ["connected_components", "content_key", "drop_stage", "split_by_key", "stage", "table"]

#: Bits of a key filter: at most 8 MB are broadcast, whatever the number of keys.
FILTER_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content_key(text: Column) -> Column:
    """The SHA-256 of a text (null: empty) as 32 bytes: equal texts, equal keys."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def split_by_key(rows: DataFrame, keys: DataFrame, key: str, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose key may be one of ``keys``, and those whose key surely isn't.

    ``rows`` has no columns `_bucket` and `_bits`. The keys mark bits of a table of fixed size, which is broadcast, so that rows of the second part need no shuffle to be told
    apart. With very many keys the first part holds all rows: the join that has to follow is exact either way.
    """
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(bits)) + 1
    marks = keys.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")
    )
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(stage(marks, "marks")), "_bucket", "left")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2
    likely = F.coalesce(bit == 1, F.lit(False))
    return marked.where(likely).select(*rows.columns), marked.where(~likely).select(*rows.columns)


def connected_components(links: DataFrame) -> DataFrame:
    """The component of every node of ``links(a, b)``: ``node, component`` (its smallest node).

    Alternating large-star and small-star steps: each step hands every neighbour of a node to
    the smallest of them, until the edges form stars. A step is a pre-aggregated minimum and a
    join, so the centre of a large star is never gathered in one task. Every round is
    written to the shared folder, and the round before it is removed. Nodes that link only to
    themselves, and null nodes, have no row; an empty table gives an empty one.
    """

    def smallest(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.min("v").alias("m"))

    def size(edges: DataFrame):
        return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    edges = stage(
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    seen = size(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        low = smallest(large)
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        after = stage(small, "links")
        now = size(after)
        drop_stage(edges)
        edges = after
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
