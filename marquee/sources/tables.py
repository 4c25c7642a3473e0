"""CSV sources: ratings, catalogue, item metadata and reviews.

Columns are taken by header name and cast explicitly; nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marquee.functions import literals, text
from marquee.sources import sampling
from marquee.sources.quoted import read_quoted

RATINGS_SAMPLE = 2_000_000


def read_csv(
    spark: SparkSession, paths: Sequence[str], quoted_lines: bool = False, number: str | None = None
) -> DataFrame | None:
    """All-string rows of the first path that exists, or None.

    ``quoted_lines`` accepts line breaks inside quotes, and ``number`` then adds a column that follows the order of the rows.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    for path in paths:
        try:
            return read_quoted(spark, path, number) if quoted_lines else reader.csv(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def _required(spark: SparkSession, folder: str, names: Sequence[str], **options) -> DataFrame:
    found = read_csv(spark, [f"{folder}/{name}" for name in names], **options)
    if found is None:
        raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")
    return found


def load_ratings(
    spark: SparkSession, folder: str, sample: int | None = None, seed: int = 42
) -> DataFrame:
    """(userId, movieId, rating) of all rows, or of a seeded sample of exactly ``sample``."""
    raw = _required(spark, folder, ["ratings.csv", "rating.csv"])
    ratings = raw.select(
        F.col("userId").cast("long").alias("userId"),
        F.col("movieId").cast("long").alias("movieId"),
        F.col("rating").cast("double").alias("rating"),
    )
    return ratings if sample is None else sample_ratings(ratings, sample, seed)


def sample_ratings(ratings: DataFrame, n: int = RATINGS_SAMPLE, seed: int = 42) -> DataFrame:
    unique = sampling.with_copy_number(ratings)
    return sampling.sample_rows(unique, n, unique.columns, seed).select(*ratings.columns)


def load_movies(spark: SparkSession, folder: str) -> DataFrame:
    raw = _required(spark, folder, ["movies.csv", "movie.csv"])
    return raw.select(F.col("movieId").cast("long").alias("movieId"), "title", "genres")


def numeric_ids(df: DataFrame) -> DataFrame:
    """Drop rows whose ``id`` is not a whole number, cast the rest."""
    return df.withColumn("id", F.col("id").try_cast("long")).where(F.col("id").isNotNull())


def one_per_id(df: DataFrame, votes: str | None = None) -> DataFrame:
    """One row per id: the most-voted, else the least in column order."""
    rest = [c for c in df.columns if c != "id"]
    row = F.struct(*rest)
    best = F.max_by(row, F.struct(F.coalesce(F.col(votes), F.lit(0.0)), row)) if votes else F.min(row)
    return df.groupBy("id").agg(best.alias("row")).select("id", *(F.col(f"row.{c}").alias(c) for c in rest))


def _left_or_blank(items: DataFrame, other: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """Left join of an optional source by id; '' where it is absent."""
    if other is not None:
        items = items.join(one_per_id(other), "id", "left")
        return items.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})
    return items.withColumns({c: F.lit("") for c in columns})


def join_details(
    items: DataFrame, keywords: DataFrame | None = None, credits: DataFrame | None = None
) -> DataFrame:
    """Metadata with keyword, cast and director names from the literal columns of two optional sources."""
    if keywords is not None:
        entries = literals.parse_entries(F.col("keywords"))
        keywords = numeric_ids(keywords).select("id", literals.keyword_names(entries).alias("keyword_names"))
    if credits is not None:
        credits = (
            numeric_ids(credits)
            .select(
                "id",
                literals.parse_entries(F.col("cast")).alias("cast"),
                literals.parse_entries(F.col("crew")).alias("crew"),
            )
            .select(
                "id",
                literals.cast_names(F.col("cast")).alias("cast_names"),
                literals.director_name(F.col("crew")).alias("director_name"),
            )
        )
    items = _left_or_blank(items, keywords, ["keyword_names"])
    return _left_or_blank(items, credits, ["cast_names", "director_name"])


def clean_metadata(raw: DataFrame) -> DataFrame:
    """Numeric ids, parsed genre names and the eight columns used later."""
    genres = literals.genre_names(literals.parse_entries(F.col("genres")))
    cleaned = numeric_ids(raw).select(
        "id",
        "title",
        genres.alias("genre_names"),
        "overview",
        "release_date",
        F.col("vote_average").try_cast("double").alias("vote_average"),
        F.coalesce(F.col("vote_count").try_cast("double"), F.lit(0.0)).alias("vote_count"),
        "original_language",
    )
    return one_per_id(cleaned, votes="vote_count")


def load_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Item metadata joined with the keywords and credits files where these exist."""
    raw = _required(spark, folder, ["movies_metadata.csv"], quoted_lines=True)
    keywords = read_csv(spark, [f"{folder}/keywords.csv"], quoted_lines=True)
    credits = read_csv(spark, [f"{folder}/credits.csv"], quoted_lines=True)
    return join_details(clean_metadata(raw), keywords, credits)


def load_reviews(spark: SparkSession, folder: str, clean: bool = True) -> DataFrame:
    """(review_id, review, sentiment), and with ``clean`` stripped text and a 0/1 ``label``.

    ``review_id`` follows the order of the rows in their files, unless the file has one.
    """
    raw = _required(spark, folder, ["IMDB Dataset.csv", "reviews.csv"], quoted_lines=True, number="_row")
    if "review_id" in raw.columns:
        raw = raw.withColumn("review_id", F.col("review_id").try_cast("long")).drop("_row")
    else:
        raw = raw.withColumnRenamed("_row", "review_id")
    return clean_reviews(raw) if clean else raw


def clean_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("review", text.clean_review(F.col("review"))).withColumn(
        "label", F.coalesce(F.col("sentiment") == "positive", F.lit(False)).cast("int")
    )


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with its rows counted while it runs; read ``observation.get`` after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows")), seen


def load_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(source, n_rows, n_columns) of loaded tables."""
    rows = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("source"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in tables.items()
    ]
    report = rows[0]
    for other in rows[1:]:
        report = report.unionByName(other)
    return report
