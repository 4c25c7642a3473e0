import random

import pytest
from pyspark.sql import functions as F

import brute
from marquee.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, seen_text string, idx int, tree string"
NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")


def checked(spark, rows, seen, arity=3):
    df = spark.createDataFrame([(*r, s, 1, "x") for r, s in zip(rows, seen, strict=True)], SCHEMA).repartition(3)
    got = merkle.verified_manifest(df, arity=arity).collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in got), key=repr) == brute.merkle(rows, seen, arity)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
    return got


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_trees_of_all_sizes(spark, arity):
    random.seed(arity)
    rows = []
    for source, n in (("b", 1), ("a", 2), ("", 3), (None, 4), ("zé", 9), ("z", 28), ("Z", 10)):
        rows += [(random.randrange(50), source, random.choice(["en", None]), random.choice([None, 7]), f"line\n{i}") for i in range(n)]
    seen = [r[4].replace("\n", "") if i % 2 else r[4] for i, r in enumerate(rows)]
    got = checked(spark, rows, seen, arity)
    assert {r["verified"] for r in got} == {True, False}


def test_nulls_empty_long_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, None, "", 0, ""), (2, "s", "en", 3, "w " * 300_000)]
    rows += [(5, "s", "en", 1, "same")] * 7 + [(5, "s", "en", 1, "other")]
    got = checked(spark, rows, [r[4] for r in rows])
    assert len(got) == len(rows) and all(r["verified"] for r in got)


def test_fields_cannot_run_into_each_other(spark):
    rows = [(1, "a", "b", 12, "c"), (1, "a", "b", 1, "2c"), (1, "a", "b", None, "-"), (1, "a", "b", None, None)]
    assert len({r["leaf"] for r in checked(spark, rows, [r[4] for r in rows])}) == 4


def test_one_row_and_none(spark):
    got = checked(spark, [(3, "s", "en", 1, "t")], ["u"])[0]
    assert got["leaf"] == got["subroot"] == got["root"] and not got["verified"]
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.verified_manifest(empty).collect() == []


def test_without_a_later_copy_all_rows_verify(spark):
    df = spark.createDataFrame([(i, "s", "en", i, "t" * i) for i in range(10)], SCHEMA.split(", seen")[0])
    assert merkle.verified_manifest(df).where(~F.col("verified")).count() == 0
