"""String functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace, word and token classes shared by every text operator.
# Java's \s and \w are ASCII only, so the Unicode classes are spelled out.
WHITESPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
TOKEN_PATTERN = rf"[{WORD}]{{2,}}"
ARTICLES = ("the", "a", "an")
YEAR_SUFFIX = rf"[{WHITESPACE}]*\([0-9]{{4}}\)[{WHITESPACE}]*$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")


def lower_strip(text: Column) -> Column:
    """Search form of a title; a missing title becomes ''."""
    return strip(F.lower(F.coalesce(text, F.lit(""))))


def words(text: Column) -> Column:
    """Whitespace-separated, non-empty pieces."""
    return F.filter(F.split(text, rf"[{WHITESPACE}]+"), lambda w: w != "")


def normalise_title(text: Column) -> Column:
    """Lower-case, without punctuation and the words the/a/an, single-spaced."""
    bare = F.regexp_replace(F.lower(text), rf"[^{WORD}{WHITESPACE}]", "")
    return F.array_join(F.filter(words(bare), lambda w: ~w.isin(*ARTICLES)), " ")


def token_sorted(text: Column) -> Column:
    return F.array_join(F.array_sort(words(text)), " ")


def detect_language(title: Column) -> Column:
    """'hi' when any character is outside ASCII, else NULL."""
    return F.when(title.rlike(r"[^\x00-\x7F]"), F.lit("hi"))


def strip_year(title: Column) -> Column:
    return F.regexp_replace(title, YEAR_SUFFIX, "")


def reorder_article(title: Column) -> Column:
    """'Matrix, The' -> 'The Matrix'; an inner ', A ' is moved to the front too."""
    the = F.when(
        F.contains(title, F.lit(", The")),
        F.concat(F.lit("The "), F.replace(title, F.lit(", The"), F.lit(""))),
    ).otherwise(title)
    return F.when(
        F.contains(the, F.lit(", A ")),
        F.concat(F.lit("A "), F.replace(the, F.lit(", A "), F.lit(" "))),
    ).otherwise(the)


def seed_title(title: Column) -> Column:
    """The form of a catalogue title that is looked up among the metadata titles."""
    return reorder_article(strip(strip_year(title)))


def canonical_title(title: Column) -> Column:
    return F.lower(seed_title(title))


def title_year(title: Column) -> Column:
    """First four digits in parentheses as INT, else NULL."""
    found = F.regexp_extract(title, r"\(([0-9]{4})\)", 1)
    return F.when(found != "", found.cast("int"))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def decade_label(title: Column) -> Column:
    """'1990s', or 'Unknown' for a title without a year."""
    return F.coalesce(
        F.concat(decade(title_year(title)).cast("string"), F.lit("s")), F.lit("Unknown")
    )


def split_genres(genres: Column) -> Column:
    """Pipe-delimited genres as an array, trimmed, without '' and 'nan'."""
    parts = F.transform(F.split(F.coalesce(genres, F.lit("")), r"\|"), strip)
    return F.filter(parts, lambda g: (g != "") & (g != "nan"))


def clean_review(text: Column) -> Column:
    """Tags to a space, whitespace collapsed, ends trimmed; NULL stays NULL."""
    untagged = F.regexp_replace(text, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(untagged, rf"[{WHITESPACE}]+", " "))


def display_year(release_date: Column) -> Column:
    return F.substring(release_date, 1, 4)


def tokens(text: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
