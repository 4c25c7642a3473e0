"""What a user has rated: totals, genre and decade counts, favourites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import text
from marquee.operators.ranking import top_n
from marquee.session import dealt

LIKED = 4.0


def only_users(history: DataFrame, users: DataFrame | None) -> DataFrame:
    """Rows of the requested users; all rows when no users are named."""
    if users is None:
        return history
    return history.join(users.select("userId").distinct(), "userId", "left_semi")


def rated_items(ratings: DataFrame, movies: DataFrame, how: str = "inner") -> DataFrame:
    return ratings.select("userId", "movieId", "rating").join(
        movies.select("movieId", "title", "genres"), "movieId", how
    )


def genre_counts(ratings: DataFrame, movies: DataFrame, min_rating: float | None = None) -> DataFrame:
    """(userId, genre, n) over all ratings, or only those of at least ``min_rating``."""
    rated = rated_items(ratings, movies)
    if min_rating is not None:
        rated = rated.where(F.col("rating") >= min_rating)
    return (
        rated.select("userId", F.explode(text.split_genres(F.col("genres"))).alias("genre"))
        .groupBy("userId", "genre")
        .agg(F.count("*").alias("n"))
    )


def decade_counts(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """(userId, decade, n) with an 'Unknown' decade for titles without a year."""
    return (
        rated_items(ratings, movies)
        .groupBy("userId", text.decade_label(F.col("title")).alias("decade"))
        .agg(F.count("*").alias("n"))
    )


def user_totals(ratings: DataFrame, digits: int = 2) -> DataFrame:
    return ratings.groupBy("userId").agg(
        F.count("*").alias("total_ratings"), F.round(F.avg("rating"), digits).alias("avg_rating")
    )


def top_rated(ratings: DataFrame, movies: DataFrame, n: int = 10, n_rows: int | None = None) -> DataFrame:
    """(userId, rank, movieId, title, rating, genres) of each user's best-rated rows."""
    best = [F.desc("rating"), F.asc("movieId"), F.asc("title")]
    rated = rated_items(dealt(ratings, n_rows, "movieId"), movies)
    return top_n(dealt(rated, n_rows, "userId"), ["userId"], best, n)


def _tagged(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def _tallies(rows: DataFrame, facts: Column, n_rows: int | None = None) -> DataFrame:
    """One (kind, value, n, total) list per user from a per-row array of tagged facts.

    Genres, decades and totals share a single pass and a single pre-aggregated
    shuffle; the collected list holds distinct values only.
    """
    return (
        dealt(rows.select("userId", "rating", facts.alias("facts")), n_rows, "userId")
        .select("userId", "rating", F.explode("facts").alias("fact"))
        .groupBy("userId", "fact")
        .agg(F.count("*").alias("n"), F.sum("rating").alias("total"))
        .groupBy("userId")
        .agg(F.collect_list(F.struct("fact.kind", "fact.value", "n", "total")).alias("tallies"))
    )


def _of_kind(kind: str) -> Column:
    return F.filter("tallies", lambda t: t["kind"] == kind)


def _count_map(kind: str) -> Column:
    pairs = F.transform(_of_kind(kind), lambda t: F.struct(t["value"], t["n"]))
    return F.map_from_entries(F.array_sort(pairs))


def _most_counted(kind: str) -> Column:
    """Values of one kind, most frequent first, ties in value order."""
    ordered = F.array_sort(F.transform(_of_kind(kind), lambda t: F.struct(-t["n"], t["value"])))
    return F.transform(ordered, lambda t: t["value"])


def user_profile(
    ratings: DataFrame,
    movies: DataFrame,
    users: DataFrame | None = None,
    n_top: int = 10,
    digits: int = 2,
    n_rows: int | None = None,
) -> DataFrame:
    """One row per user: totals, genre and decade maps, and the best-rated titles.

    ``n_rows``, the number of ratings where it is known, decides over how many tasks they are dealt.
    """
    history = only_users(ratings, users)
    rated = rated_items(dealt(history, n_rows, "movieId"), movies.withColumn("title", F.coalesce("title", F.lit(""))), "left")
    known = F.col("title").isNotNull()
    facts = F.concat(
        F.array(_tagged("total", F.lit(""))),
        F.when(known, F.array(_tagged("decade", text.decade_label(F.col("title"))))).otherwise(
            F.array().cast("array<struct<kind:string,value:string>>")
        ),
        F.transform(text.split_genres(F.col("genres")), lambda g: _tagged("genre", g)),
    )
    total = _of_kind("total")[0]
    counts = _tallies(rated, facts, n_rows).select(
        "userId",
        total["n"].alias("total_ratings"),
        F.round(total["total"] / total["n"], digits).alias("avg_rating"),
        _count_map("genre").alias("genre_counts"),
        _count_map("decade").alias("decade_counts"),
    )
    best = (
        top_rated(history, movies, n_top, n_rows)
        .groupBy("userId")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "title", "rating", "genres"))).alias("top_rated"))
    )
    empty = F.array().cast(best.schema["top_rated"].dataType)
    return counts.join(best, "userId", "left").withColumn("top_rated", F.coalesce("top_rated", empty))


def taste_profile(
    ratings: DataFrame,
    movies: DataFrame,
    users: DataFrame | None = None,
    min_rating: float = LIKED,
    n_genres: int = 5,
    n_titles: int = 5,
) -> DataFrame:
    """One row per user: ``top_genres``, ``top_decade``, ``top_movies``, ``total_rated``.

    Genres and decades count liked ratings only; titles and the total use all.
    """
    history = only_users(ratings, users)
    rated = rated_items(history, movies, "left")
    none = F.array().cast("array<struct<kind:string,value:string>>")
    year = text.title_year(F.col("title"))
    liked = F.concat(
        F.transform(text.split_genres(F.col("genres")), lambda g: _tagged("genre", g)),
        F.when(year > 0, F.array(_tagged("decade", text.decade(year).cast("string")))).otherwise(none),
    )
    facts = F.concat(
        F.array(_tagged("total", F.lit(""))), F.when(F.col("rating") >= min_rating, liked).otherwise(none)
    )
    counts = _tallies(rated, facts).select(
        "userId",
        F.slice(_most_counted("genre"), 1, n_genres).alias("top_genres"),
        F.try_element_at(_most_counted("decade"), F.lit(1)).cast("int").alias("top_decade"),
        _of_kind("total")[0]["n"].alias("total_rated"),
    )
    titles = (
        top_rated(history, movies, n_titles)
        .groupBy("userId")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("ranked"))
        .select("userId", F.transform("ranked", lambda r: r["title"]).alias("top_movies"))
    )
    return counts.join(titles, "userId", "left").withColumn(
        "top_movies", F.coalesce("top_movies", F.array().cast("array<string>"))
    )
