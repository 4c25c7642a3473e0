from pyspark.sql import functions as F

from marquee.llm import shared


def test_rows_split_by_a_key_filter(spark):
    rows = spark.range(3000).select("id", F.concat(F.lit("k"), "id").alias("key"))
    keys = spark.range(0, 3000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    for bits in (1 << 26, 1 << 15, 64):
        likely, surely = shared.split_by_key(rows, keys, "key", bits)
        a, b = {r.id for r in likely.collect()}, {r.id for r in surely.collect()}
        assert not a & b and len(a) + len(b) == 3000 and {i for i in range(3000) if i % 7 == 0} <= a
        assert len(a) < (450 if bits == 1 << 26 else 3001)
    none = shared.split_by_key(rows, keys.limit(0), "key")
    assert none[0].count() == 0 and none[1].count() == 3000
    binary = [d.withColumn("key", F.unhex(F.sha2("key", 256))) for d in (rows, keys)]
    assert shared.split_by_key(*binary, "key")[0].count() < 450
