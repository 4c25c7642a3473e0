import pytest
from pyspark.sql import functions as F

from marquee.functions import display, literals, text


def evaluate(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (text.lower_strip, ["  The X 　", None, "\tÀ b\n"], ["the x", "", "à b"]),
    (text.normalise_title, ["The Lord: of a  Ring!", "An a the", "Amélie_2"], ["lord of ring", "", "amélie_2"]),
    (text.detect_language, ["Toy Story", "Amélie", ""], [None, "hi", None]),
    (text.strip_year, ["X (1999)", "X (1999) ", "X (19999)", "(2001) X"], ["X", "X", "X (19999)", "(2001) X"]),
    (
        text.seed_title,
        ["Matrix, The (1999)", "Walk, A Long (1990)", "X, A (1990)", "Cat (1980)"],
        ["The Matrix", "A Walk Long", "X, A", "Cat"],
    ),
    (text.title_year, ["X (1999) (2001)", "X", "X (199)"], [1999, None, None]),
    (text.decade_label, ["X (1999)", "X"], ["1990s", "Unknown"]),
    (text.split_genres, ["A| B ||nan", None, ""], [["A", "B"], [], []]),
    (text.clean_review, ["a<br /><br />b \n c ", None, "<i>x</i>"], ["a b c", None, "x"]),
    (text.tokens, ["It's a café_1 x"], [["it", "café_1"]]),
    (text.display_year, ["1995-10-30", None], ["1995", None]),
    (display.genre_category, ["Sci-Fi|Drama", "Comedy|Action", None, "War"], ["fantastic", "action", "other", "other"]),
    (display.genre_display, ["A|B"], ["A · B"]),
    (display.language_code, ["Hindi", "Auto detect", "Klingon"], ["hi", None, None]),
    (display.genre_choice, ["Any", "Drama"], [None, "Drama"]),
]


@pytest.mark.parametrize("fn, values, expected", CASES, ids=[c[0].__name__ for c in CASES])
def test_string_functions(spark, fn, values, expected):
    assert evaluate(spark, fn, values) == expected


def test_literal_lists(spark):
    values = [
        "[{'id': 1, 'name': 'Drama'}, {'name': 'War Film'}]",
        "[{'name': \"Schindler's\"}]",
        "[{'id': None, 'flag': True, 'name': 'A\\x41'}]",
        "[{'id': 1}]",
        "",
        "junk",
        None,
        "[]",
        "[1, 2]",
    ]
    genres = evaluate(spark, lambda c: literals.genre_names(literals.parse_entries(c)), values)
    assert genres == ["Drama War Film", "Schindler's", "AA", "", "", "", "", "", ""]
    keywords = evaluate(spark, lambda c: literals.keyword_names(literals.parse_entries(c)), values)
    assert keywords[0] == "Drama WarFilm"


def test_cast_and_director(spark):
    cast = ["[{'name': 'A B'}, {'name': 'C'}, {'name': 'D E F'}, {}]", "[{'name': 'A'}, {}]"]
    assert evaluate(spark, lambda c: literals.cast_names(literals.parse_entries(c)), cast) == ["AB C DEF", ""]
    crew = [
        "[{'job': 'Writer', 'name': 'W'}, {'job': 'Director', 'name': 'D One'}, {'job': 'Director', 'name': 'Two'}]",
        "[{'job': 'Writer', 'name': 'W'}]",
        "[{'name': 'W'}, {'job': 'Director', 'name': 'D'}]",
        "[{'job': 'Director', 'name': 'D'}, {'name': 'W'}]",
        "[{'job': None, 'name': 'W'}, {'job': 'Director', 'name': 'D'}]",
        "[{'job': 'Director'}]",
    ]
    found = evaluate(spark, lambda c: literals.director_name(literals.parse_entries(c)), crew)
    assert found == ["DOne", "", "", "D", "D", ""]


def test_audience_label(spark):
    df = spark.createDataFrame([(0.9,), (0.7,), (0.4,)], "s double")
    assert [r[0] for r in df.select(display.audience_label(F.col("s"))).collect()] == ["Loved", "Liked", "Mixed"]
