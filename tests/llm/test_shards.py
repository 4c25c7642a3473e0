import random

from pyspark.sql import functions as F

from marquee.llm import shards

SCHEMA = "doc_id long, text string"


def checked(df, limit):
    rows = shards.shard_documents(df, limit).collect()
    names = {r["shard"] for r in rows}
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    for name in names:
        inside = [r for r in rows if r["shard"] == name]
        total = sum(r["n_bytes"] for r in inside)
        assert {(r["shard_docs"], r["shard_bytes"], r["depth"]) for r in inside} == {(len(inside), total, len(name))}
        assert total <= limit or len(inside) == 1
        if name:  # its parent was oversized
            family = [r for r in rows if r["shard"].startswith(name[:-1])]
            assert sum(r["n_bytes"] for r in family) > limit and len(family) > 1
    return rows


def test_shards_are_the_first_prefixes_that_fit(spark):
    random.seed(1)
    rows = [(i, "x" * random.randint(0, 400)) for i in range(300)] + [(1000, "y" * 5000), (1001, None), (None, "z")]
    got = checked(spark.createDataFrame(rows, SCHEMA).repartition(3), 1000)
    assert len(got) == len(rows)


def test_equal_rows_are_split_too(spark):
    got = checked(spark.createDataFrame([(1, "x" * 100)] * 60 + [(2, "y" * 50)], SCHEMA), 500)
    assert len(got) == 61 and max(r["depth"] for r in got) > shards.HASH_BITS


def test_one_shard_if_all_fit(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], SCHEMA)
    assert [(r["shard"], r["depth"]) for r in shards.shard_documents(df).collect()] == [("", 0)] * 2
    assert shards.shard_documents(df.limit(0)).collect() == []


def test_written_shards_hold_all_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 50, i) for i in range(40)], SCHEMA + ", depth int")
    shards.write_shards(df, shards.shard_documents(df, 300), f"{tmp_path}/s")
    back = spark.read.option("recursiveFileLookup", False).parquet(f"{tmp_path}/s")
    assert back.count() == 40 and back.agg(F.sum("depth")).first()[0] == sum(range(40))


def test_null_and_repeated_ids_are_written_once(spark, tmp_path):
    rows = [(None, "n" * 50, 1)] * 3 + [(7, "x" * 100, i) for i in range(30)] + [(8, c * 40, 1) for c in "abc"]
    rows += [(i, "y" * 50, 1) for i in range(100, 130)] + [(9, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", place int").repartition(3)
    found = shards.shard_documents(df, 300)
    shards.write_shards(df, found, f"{tmp_path}/s")
    back = spark.read.schema(SCHEMA + ", place int, shard string").parquet(f"{tmp_path}/s").collect()
    assert sorted(map(repr, (tuple(r)[:3] for r in back))) == sorted(map(repr, rows))
    size = lambda r: len(r["text"] or "")
    written = sorted((r["doc_id"] or 0, size(r), r["shard"]) for r in back)
    assert written == sorted((r["doc_id"] or 0, r["n_bytes"], r["shard"]) for r in found.collect())
