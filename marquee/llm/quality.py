"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that separate words and the symbols that are counted.
GAPS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as was are by this be at from or an "
    "der die das und ist nicht ein eine mit von zu den im auf für dem sich des "
    "le la les et de du que qui dans une un pour est pas sur au par "
    "el los las y en es por con para del una se no su al lo"
).split()

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``low <= metric <= high``; a missing bound is no bound."""

    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_chars", low=2, high=20),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_ratio", low=0.01),
    Rule("dup_line_ratio", high=0.5),
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeated_starts(grams: Column) -> Column:
    """The places, in order, of the windows that occur twice or more, for windows with (g, i)."""
    beside = lambda i: F.get(grams, i)["g"]
    twice = F.filter(grams, lambda x, i: x["g"].eqNullSafe(beside(i - 1)) | x["g"].eqNullSafe(beside(i + 1)))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def metrics(docs: DataFrame, stop_words: tuple[str, ...] | list[str] = STOP_WORDS, text: str = "text") -> DataFrame:
    """``docs`` with a column ``quality``: the counts and ratios of every whole text.

    Words are maximal runs of characters other than space, tab, line feed, vertical tab, form feed and
    carriage return. A null or empty text has no words; ratios without a denominator are 0.
    ``n_repeat_words`` counts the words inside 8-word windows found twice or more in the text.
    Only a text in which a window repeats has its windows sorted. Columns of ``docs`` stay as they are, also those with the names of metrics,
    since all results are fields of one struct.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    step = docs.select(F.struct(*kept).alias("row"), body.alias("body"))
    step = step.select(
        "row",
        "body",
        F.filter(F.split("body", f"[{GAPS}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("body", "\n"), lambda line: F.length(_without(line, GAPS)) > 0).alias("lines"),
    )
    step = step.withColumn("n_words", F.size("words").cast("long"))
    step = step.withColumn("marks", F.transform("words", lambda w: F.xxhash64(w)))
    grams = F.transform(F.sequence(F.lit(1), F.size("marks") - WINDOW + 1), lambda i: F.xxhash64(F.slice("marks", i, WINDOW)))
    none = F.array().cast("array<bigint>")
    step = step.withColumn("grams", F.when(F.col("n_words") > WINDOW, grams).otherwise(none))
    numbered = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    step = step.withColumn(
        "sorted",
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), numbered).otherwise(
            F.array().cast("array<struct<g:bigint,i:int>>")
        ),
    )
    step = step.withColumn("starts", _repeated_starts(F.col("sorted")))
    covered = F.aggregate(
        F.transform(
            "starts",
            lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - at, F.lit(WINDOW))).cast("long"),
        ),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    stops = [w.lower() for w in stop_words]
    step = step.select(
        "row",
        "n_words",
        F.length(_without(F.col("body"), GAPS)).cast("long").alias("word_chars"),
        (F.length("body") - F.length(_without(F.col("body"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop_words"),
    )
    share = lambda part, whole: F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))
    return step.select(
        "row.*",
        F.struct(
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "n_lines",
            "n_stop_words",
            (100 * share("n_repeat_words", "n_words")).alias("repeat_percent"),
            share("word_chars", "n_words").alias("mean_word_chars"),
            share("n_symbols", "word_chars").alias("symbol_ratio"),
            share("n_stop_words", "n_words").alias("stop_ratio"),
            share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ).alias("quality"),
    )


def compile_rules(rules: tuple[Rule, ...], scores: str = "quality") -> Column:
    """One boolean expression: true where every rule of the table holds."""
    holds = F.lit(True)
    for rule in rules:
        value = F.col(scores)[rule.metric]
        if rule.low is not None:
            holds = holds & (value >= rule.low)
        if rule.high is not None:
            holds = holds & (value <= rule.high)
    return holds


def base_failed() -> Column:
    """Fewer than 20 words, or over 30 percent of them in repeated windows, in whole numbers."""
    q = F.col("quality")
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the structs ``quality`` (metrics) and ``verdict`` (base_failed, kept)."""
    return metrics(docs, text=text).withColumn(
        "verdict",
        F.struct(base_failed().alias("base_failed"), (~base_failed() & compile_rules(rules)).alias("kept")),
    )


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are.

    The row number, different for each run of a row as far as the optimiser knows, keeps it from copying the whole
    projection into the filter once for each use of a metric.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col("text"))
    judged = judge(rows, rules).withColumn("number", F.monotonically_increasing_id())
    return judged.where("verdict.kept and number >= 0").select("document.*")
