import random

import pytest
from pyspark.sql import functions as F

import brute
from marquee.llm import quality

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def texts():
    random.seed(5)
    out = [None, "", " \t\n\x0b\x0c\r ", "one", "a " * 8, "a b c d e f g h", "x\n\nx\n x\nx", "é😀 #*$%&|<> ü" * 9]
    out += [" ".join(random.choice("abc") for _ in range(random.randint(0, 60))) for _ in range(60)]
    phrase = " ".join(f"w{i}" for i in range(12))
    out += [f"{phrase} mid {phrase}", f"{phrase} {phrase} {phrase}", "the end of it " * 5000]
    return out


def judged(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = quality.judge(df).select("doc_id", *[F.col("quality")[n] for n in NAMES], "verdict.base_failed")
    return {r[0]: tuple(r[1:]) for r in got.collect()}


def test_counts_equal_brute_force(spark):
    rows = texts()
    assert judged(spark, rows) == {i: brute.quality(t) for i, t in enumerate(rows)}


def test_thresholds_are_compiled_into_the_verdict(spark):
    good = "the cat and the dog are in the house of a friend who was not at home on that day " * 1
    rows = [good, good.replace(" ", " ### "), "zzz " + " ".join(f"q{i}xx" for i in range(30)), "the of"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df).select("doc_id", "verdict.kept").collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False}
    assert not quality.keep(df, rules=(quality.Rule("n_words", high=5),)).count()


def test_kept_rows_have_their_own_columns(spark):
    good = "the cat and the dog are in the house of a friend who was not at home on that day "
    schema = "doc_id long, text string, quality int, verdict string, row long, number int"
    df = spark.createDataFrame([(1, good, 2, "x", 3, 4), (2, "no", 5, "y", 6, 7)], schema)
    assert [tuple(r) for r in quality.keep(df).collect()] == [(1, good, 2, "x", 3, 4)]


def test_one_projection_without_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = quality.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_columns_with_the_names_of_metrics_stay(spark):
    df = spark.createDataFrame([(1, "a b", 7, "w")], "doc_id long, text string, n_words int, words string")
    row = quality.judge(df).first()
    assert (row["n_words"], row["words"], row["quality"]["n_words"]) == (7, "w", 2)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(empty).collect() == []


@pytest.mark.parametrize("n", [7, 8, 9])
def test_short_texts_have_no_repeated_windows(spark, n):
    assert judged(spark, ["a " * n])[0] == brute.quality("a " * n)


def test_a_very_long_clean_text_stays(spark):
    book = " ".join(f"the w{i}" for i in range(500_001))
    df = spark.createDataFrame([(1, book)], "doc_id long, text string")
    verdict = quality.judge(df).select("quality.n_words", "verdict.kept").first()
    assert tuple(verdict) == (1_000_002, True)
    assert quality.keep(df).count() == 1
