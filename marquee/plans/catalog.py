"""The registered queries, each over the whole of the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.functions import display, text
from marquee.operators import (
    attribution,
    classifier,
    collab,
    content,
    ensemble,
    explain,
    factor,
    profile,
    ranking,
    report,
    sentiment,
    titles,
)
from marquee.plans import recommend as top
from marquee.plans.views import LEXICON, MOST_RATED, STOP_WORDS, Views
from marquee.session import dealt, shared_folder, stage
from marquee.sources import sampling, tables

# The test tables have fewer ratings and votes per item than the default cuts ask for.
CUTS = {"min_movie_ratings": 20, "min_user_ratings": 20}
MIN_VOTES = 20

Query = Callable[[Views], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: lambda spark, folder, fn=fn: fn(Views(spark, folder)) for name, fn in QUERIES.items()
    }


def _lines(items: Column, *fields: str) -> Column:
    """An array of structs as text, one piece per element."""
    return F.array_join(
        F.transform(items, lambda e: F.concat_ws("=", *[e[f].cast("string") for f in fields])), ";"
    )


# --- sources ---------------------------------------------------------------------------


@registered
def load_report(v: Views) -> DataFrame:
    return tables.load_report(
        {"ratings": v.ratings, "movies": v.movies, "metadata": v.metadata, "reviews": v.reviews}
    )


@registered
def metadata_from_literals(v: Views) -> DataFrame:
    """Dirty ids and votes, literal lists, keywords and credits through the cleaning path."""
    cleaned = tables.clean_metadata(v.raw_metadata)
    return tables.join_details(cleaned, v.raw_keywords, v.raw_credits).drop("vote_average", "overview")


@registered
def metadata_from_csv(v: Views) -> DataFrame:
    """The same tables written as CSV files and loaded by name."""
    folder = f"{shared_folder(v.spark)}/csv-{uuid.uuid4().hex}"
    files = {
        "movies_metadata.csv": v.raw_metadata,
        "keywords.csv": v.raw_keywords,
        "credits.csv": v.raw_credits,
    }
    for name, df in files.items():
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    loaded = tables.load_metadata(v.spark, folder)
    return loaded.select("id", "title", "genre_names", "keyword_names", "cast_names", "director_name", "vote_count")


@registered
def ratings_from_csv(v: Views) -> DataFrame:
    folder = f"{shared_folder(v.spark)}/csv-{uuid.uuid4().hex}"
    for name, df in {"rating.csv": v.ratings, "movies.csv": v.movies}.items():
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    ratings = tables.load_ratings(v.spark, folder, sample=None)
    return (
        ratings.join(tables.load_movies(v.spark, folder), "movieId")
        .groupBy("movieId", "title", "genres")
        .agg(F.count("*").alias("n"), F.sum("rating").alias("total"))
    )


@registered
def rating_sample(v: Views) -> DataFrame:
    return (
        tables.sample_ratings(v.ratings, 5000)
        .groupBy("userId", "movieId", "rating")
        .agg(F.count("*").alias("copies"))
    )


@registered
def train_validation_split(v: Views) -> DataFrame:
    split = sampling.train_validation_split(v.labelled, ["review_id"], 200, 100)
    return split.select("review_id", "part")


@registered
def reviews_cleaned(v: Views) -> DataFrame:
    return tables.clean_reviews(v.reviews).select("review_id", "movieId", "review", "label")


@registered
def pages_cleaned(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", text.clean_review(F.col("html")).alias("review"))


@registered
def class_counts(v: Views) -> DataFrame:
    return sentiment.class_counts(v.labelled)


# --- scalar functions ------------------------------------------------------------------


@registered
def title_functions(v: Views) -> DataFrame:
    title = F.col("title")
    return v.odd_titles.select(
        "movieId",
        text.detect_language(title).alias("lang"),
        text.lower_strip(title).alias("title_lower"),
        text.normalise_title(title).alias("title_norm"),
        text.strip_year(title).alias("yearless"),
        text.seed_title(title).alias("lookup"),
        text.title_year(title).alias("year"),
        text.decade_label(title).alias("decade"),
        text.token_sorted(F.lower(title)).alias("sorted_words"),
    )


@registered
def documents_normalised(v: Views) -> DataFrame:
    return v.table("documents").select(
        "doc_id",
        text.normalise_title(F.col("text")).alias("normalised"),
        text.detect_language(F.col("text")).alias("lang_rule"),
        F.size(text.tokens(F.col("text"))).alias("n_tokens"),
    )


@registered
def request_filters(v: Views) -> DataFrame:
    label = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "es", "Spanish")
    label = label.when(F.col("lang") == "de", "German").otherwise("Auto detect")
    genre = F.when(F.col("doc_id") % 3 == 0, "Any").otherwise(F.col("source"))
    return v.table("documents").select(
        "doc_id", display.language_code(label).alias("lang"), display.genre_choice(genre).alias("genre")
    )


@registered
def genre_labels(v: Views) -> DataFrame:
    """Category and display form of genre strings made of the words of each document."""
    return v.table("documents").select(
        "doc_id",
        display.genre_category(F.col("text")).alias("category"),
        display.genre_display(F.concat_ws("|", "lang", "source")).alias("shown"),
    )


# --- profiles --------------------------------------------------------------------------


@registered
def user_totals(v: Views) -> DataFrame:
    return profile.user_totals(v.ratings, digits=6)


@registered
def genre_counts(v: Views) -> DataFrame:
    return profile.genre_counts(v.ratings, v.movies)


@registered
def liked_genre_counts(v: Views) -> DataFrame:
    return profile.genre_counts(v.ratings, v.movies, profile.LIKED)


@registered
def decade_counts(v: Views) -> DataFrame:
    return profile.decade_counts(v.ratings, v.movies)


@registered
def top_rated(v: Views) -> DataFrame:
    return profile.top_rated(v.ratings, v.movies).select("userId", "rank", "title", "rating", "genres")


@registered
def user_profile(v: Views) -> DataFrame:
    best = F.transform(
        "top_rated",
        lambda t: F.struct(
            t["title"].alias("title"), (t["rating"] * 2).alias("rating"), t["genres"].alias("genres")
        ),
    )
    return profile.user_profile(v.ratings, v.movies, digits=6, n_rows=v.n_ratings).select(
        "userId",
        "total_ratings",
        "avg_rating",
        _lines(F.map_entries("genre_counts"), "key", "value").alias("genre_counts"),
        _lines(F.map_entries("decade_counts"), "key", "value").alias("decade_counts"),
        _lines(best, "title", "rating", "genres").alias("top_rated"),
    )


@registered
def taste_profile(v: Views) -> DataFrame:
    return profile.taste_profile(v.ratings, v.movies).select(
        "userId",
        F.array_join("top_genres", ";").alias("top_genres"),
        "top_decade",
        F.array_join("top_movies", ";").alias("top_movies"),
        "total_rated",
    )


@registered
def user_card(v: Views) -> DataFrame:
    card = report.user_card(profile.user_profile(v.ratings, v.movies, digits=6))
    return card.select(
        "userId",
        "total_ratings",
        "avg_rating",
        "top_genre",
        "top_decade",
        F.array_join("leading_genres", ";").alias("leading_genres"),
        F.array_join("decades", ";").alias("decades"),
        _lines(F.col("titles"), "title", "category", "genres").alias("titles"),
    )


# --- collaborative ---------------------------------------------------------------------


def _dense(v: Views) -> DataFrame:
    return collab.dense_enough(v.ratings, **CUTS, n_rows=v.n_ratings)


@registered
def collab_matrix(v: Views) -> DataFrame:
    return collab.user_item_means(_dense(v)).withColumn("rating", F.round("rating", 6))


@registered
def collab_shape(v: Views) -> DataFrame:
    return collab.matrix_shape(_dense(v))


@registered
def user_neighbours(v: Views) -> DataFrame:
    found = collab.user_neighbours(collab.user_item_means(_dense(v)))
    return found


def _collab(v: Views, n: int = 10) -> DataFrame:
    dense = stage(_dense(v), "dense-ratings")
    # Users are placed once: means and lengths of their rows need no further shuffle.
    by_user = dealt(dense, v.n_ratings, "userId")
    means = collab.user_item_means(by_user if by_user is not dense else dense.repartition("userId"))
    return collab.collab_recommendations(means, dense, v.ratings, n=n, n_rows=v.n_ratings)


@registered
def collab_recommendations(v: Views) -> DataFrame:
    return _collab(v)


@registered
def normalised_scores(v: Views) -> DataFrame:
    return ensemble.normalise_scores(_collab(v), "score", digits=6)


# --- content ---------------------------------------------------------------------------


def _content(v: Views) -> content.ContentModel:
    return content.build_content_model(v.metadata, STOP_WORDS, content.MAX_FEATURES)


@registered
def content_soup(v: Views) -> DataFrame:
    return content.with_soup(v.metadata, min_words=16).select("id", "soup", "vote_count")


@registered
def search_table(v: Views) -> DataFrame:
    return titles.search_table(v.metadata).withColumn("year", text.display_year(F.col("release_date")))


def _terms(v: Views) -> tuple[DataFrame, DataFrame]:
    kept = stage(content.with_soup(v.metadata).select("id", "soup"), "content-items")
    n_tasks = content.text_tasks(kept)
    counts = content.term_counts(kept, STOP_WORDS, n_tasks)
    n_texts = kept.agg(F.count("*").alias("n")).scalar()
    return counts, content.vocabulary(counts, n_texts, content.MAX_FEATURES, n_tasks)


@registered
def vocabulary(v: Views) -> DataFrame:
    return _terms(v)[1].withColumn("idf", F.round("idf", 6))


@registered
def tfidf_weights(v: Views) -> DataFrame:
    weights = content.tfidf_weights(*_terms(v), bounded=True)
    return weights.select("id", "term", F.round("weight", 6).alias("weight"))


@registered
def similar_items(v: Views) -> DataFrame:
    """Lists around every item of the catalogue."""
    model = _content(v)
    seeds = model.items.select(F.col("id").alias("seed_id"), "id")
    found = content.similar_items(model, seeds, min_votes=MIN_VOTES)
    return found.select("seed_id", "rank", "id", "score")


@registered
def similar_filtered(v: Views) -> DataFrame:
    """Every item as a seed, asking for its own genre and, for even ids, its own language."""
    model = _content(v)
    seeds = model.items.select(
        F.col("id").alias("seed_id"),
        "id",
        F.upper(F.split("genre_names", " ")[0]).alias("genre"),
        F.when(F.col("id") % 2 == 0, F.col("original_language")).alias("lang"),
    )
    found = content.similar_items(model, seeds, 20, min_votes=MIN_VOTES)
    return content.as_shown(found, 9)


@registered
def similar(v: Views) -> DataFrame:
    """Similar titles asked for by title, one request per catalogue entry."""
    requests = v.movies.select(
        F.col("movieId").alias("request_id"), text.seed_title(F.col("title")).alias("title")
    )
    return top.similar(_content(v), requests, min_votes=MIN_VOTES, digits=9)


# --- titles ----------------------------------------------------------------------------


@registered
def resolve_titles(v: Views) -> DataFrame:
    """Exact and normalised matches of altered titles."""
    found = titles.resolve_titles(v.title_queries, titles.search_table(v.metadata), fuzzy=False)
    return found.select("title", "id", "matched_by")


@registered
def resolve_shared_titles(v: Views) -> DataFrame:
    """Titles that many items share go to the most-voted item."""
    items = v.metadata.withColumn("title", F.col("raw_title"))
    asked = items.select(F.initcap("raw_title").alias("title"))
    return titles.resolve_titles(asked, titles.search_table(items)).select("title", "id")


@registered
def resolve_fuzzy(v: Views) -> DataFrame:
    """Misspelt and shortened titles through all four stages."""
    return titles.resolve_titles(v.misspelt, titles.search_table(v.metadata))


@registered
def search_titles(v: Views) -> DataFrame:
    asked = v.misspelt.select(F.col("title").alias("query"))
    return titles.search_titles(asked, titles.search_table(v.metadata))


# --- factors ---------------------------------------------------------------------------


@registered
def most_rated(v: Views) -> DataFrame:
    items = factor.most_rated(v.ratings, "movieId", MOST_RATED["movies"])
    users = factor.most_rated(v.ratings, "userId", MOST_RATED["users"])
    return items.select(F.lit("movie").alias("kind"), F.col("movieId").alias("id"), "count").unionByName(
        users.select(F.lit("user").alias("kind"), F.col("userId").alias("id"), "count")
    )


@registered
def svd_matrix(v: Views) -> DataFrame:
    return factor.svd_matrix(v.ratings).withColumn("rating", F.round("rating", 6))


@registered
def svd_recommendations(v: Views) -> DataFrame:
    return factor.svd_recommendations(factor.build_svd_model(v.ratings), v.ratings, v.movies)


@registered
def svd_checks(v: Views) -> DataFrame:
    """Counts of what must never happen in a factor model and its lists: all of them 0."""
    ratings = stage(v.ratings, "ratings")
    model = factor.build_svd_model(ratings)
    lists = stage(factor.svd_scores(model, ratings), "svd-lists")
    k = model.sigma.count()
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    f = F.col("factors")
    gram = model.item_factors.agg(*[F.sum(f[i] * f[j]).alias(f"g{i}_{j}") for i, j in cells])
    off = [F.when(F.abs(F.col(f"g{i}_{j}") - float(i == j)) > 1e-6, 1).otherwise(0) for i, j in cells]
    after = F.lead("sigma").over(Window.orderBy("factor"))
    means = collab.user_item_means(ratings)
    energy = means.agg(F.sum(F.col("rating") ** 2).alias("all"))
    held = model.sigma.agg(F.sum(F.col("sigma") ** 2).alias("held"))
    seen = ratings.select("userId", "movieId").distinct()
    gaps = lists.groupBy("userId").agg(F.max("rank").alias("last"), F.countDistinct("rank").alias("n"))
    counts = (
        ("columns of V that are not orthonormal", gram.select(sum(off, F.lit(0)).alias("n"))),
        ("singular values out of order", model.sigma.withColumn("next", after).agg(F.count_if(F.expr("next > sigma + 1e-9")).alias("n"))),
        ("more energy than the ratings have", held.join(energy, F.col("held") > F.col("all") * (1 + 1e-9)).agg(F.count("*").alias("n"))),
        ("users without recommendations", ratings.select("userId").distinct().join(lists, "userId", "left_anti").agg(F.count("*").alias("n"))),
        ("seen films recommended", lists.join(seen, ["userId", "movieId"], "left_semi").agg(F.count("*").alias("n"))),
        ("ranks with gaps", gaps.agg(F.count_if(F.expr("last != n")).alias("n"))),
    )
    rows = [df.select(F.lit(name).alias("violation"), F.col("n").cast("int").alias("n")) for name, df in counts]
    return reduce(DataFrame.unionByName, rows)


# --- ensemble --------------------------------------------------------------------------


@registered
def favourite_seeds(v: Views) -> DataFrame:
    return ensemble.favourite_seeds(v.ratings, v.movies).select("userId", "seed", "title")


@registered
def merge_scored(v: Views) -> DataFrame:
    """Three lists per customer taken from the order lines, merged and cut."""
    shifted = dealt(v.ratings, v.n_ratings, "userId").groupBy("userId", "movieId").agg(F.sum("rating").alias("total"))
    n_items = v.movies.agg(F.count("*").alias("n")).scalar()

    # The three lists are taken from these rows, which are found once.
    best = stage(ranking.top_n(shifted, ["userId"], [F.desc("total"), F.asc("movieId")], top.LIST_LENGTH), "best-lines")

    def listed(step: int, name: str) -> DataFrame:
        return best.select(
            "userId", F.pmod(F.col("movieId") + step, n_items).alias("movieId"), F.col("total").alias(name)
        )

    names = v.movies.select("movieId", "title")
    named = lambda recs: dealt(recs, v.n_ratings, "movieId").join(names, "movieId").drop("movieId")
    return ensemble.merge_scored(
        listed(1, "score"),
        named(listed(2, "similarity_score")),
        named(listed(1, "predicted_rating")),
        v.ratings,
        v.movies,
        digits=6,
        n_rows=v.n_ratings,
    )


def _models(v: Views, with_svd: bool, max_features: int | None = None) -> top.Models:
    ratings = stage(v.ratings, "ratings")  # a join here, a table elsewhere
    return top.build_models(
        ratings, v.movies, v.metadata, **CUTS, stop_words=STOP_WORDS, with_svd=with_svd, max_features=max_features
    )


@registered
def hybrid_without_svd(v: Views) -> DataFrame:
    """By raw title, as its SQL has it: lists that name a film differently don't meet."""
    models = _models(v, False, content.MAX_FEATURES)
    return top.hybrid_recommend(models, min_votes=MIN_VOTES, fuzzy=False, title_key="raw", digits=6)


@registered
def hybrid_recommendations(v: Views) -> DataFrame:
    return top.hybrid_recommend(_models(v, True), min_votes=MIN_VOTES)


@registered
def hybrid_checks(v: Views) -> DataFrame:
    """Counts of what must never happen in the lists of the collaborative and content models, merged by film: all of them 0."""
    models = _models(v, False)
    lists = stage(top.hybrid_recommend(models, min_votes=MIN_VOTES), "hybrid-lists")
    name = text.canonical_title(F.col("title")).alias("name")
    named = lists.select("userId", name)
    rated = v.ratings.select("userId", "movieId").join(v.movies, "movieId").select("userId", name).distinct()
    whole = lists.groupBy("userId").agg(F.max("rank").alias("last"), F.countDistinct("rank").alias("n"))
    after = F.lead("hybrid_score").over(Window.partitionBy("userId").orderBy("rank"))
    people = models.dense.select("userId").distinct()
    rows = (
        ("seen films", named.join(rated, ["userId", "name"], "left_semi").agg(F.count("*").alias("n"))),
        ("films twice in a list", named.agg((F.count("*") - F.countDistinct("userId", "name")).alias("n"))),
        ("ranks with gaps", whole.agg(F.count_if(F.expr("last != n")).alias("n"))),
        ("scores out of order", lists.withColumn("next", after).agg(F.count_if(F.expr("next > hybrid_score")).alias("n"))),
        ("scores out of range", lists.agg(F.count_if(~F.col("hybrid_score").between(0, 1)).alias("n"))),
        ("active users without a list", people.join(lists, "userId", "left_anti").agg(F.count("*").alias("n"))),
        ("items in both tables not bridged", v.movies.join(models.content.items.select(F.col("id").alias("movieId")), "movieId")
         .join(models.bridge.where("same and movieId = id"), "movieId", "left_anti").agg(F.count("*").alias("n"))),
    )
    counted = [df.select(F.lit(label).alias("violation"), F.col("n").cast("int").alias("n")) for label, df in rows]
    return reduce(DataFrame.unionByName, counted)


# --- sentiment -------------------------------------------------------------------------


def _lexicon(v: Views) -> DataFrame:
    return v.spark.createDataFrame(list(LEXICON), "token string, valence double")


def _scores(v: Views, rules: bool = False, digits: int = 6) -> DataFrame:
    scores = sentiment.lexicon_scores(v.reviews, _lexicon(v), rules, digits)
    return v.reviews.drop("review").join(scores, "review_id")


@registered
def lexicon_core(v: Views) -> DataFrame:
    return _scores(v).select("review_id", "compound")


@registered
def lexicon_rules(v: Views) -> DataFrame:
    """Every document scored with the intensity, negation, capitals and 'but' rules."""
    docs = v.table("documents").select(F.col("doc_id").alias("review_id"), F.col("text").alias("review"))
    return sentiment.lexicon_scores(docs, _lexicon(v), True, 6)


@registered
def item_sentiment(v: Views) -> DataFrame:
    means = sentiment.item_sentiment(_scores(v))
    return means.select(
        "movieId",
        F.round("sentiment", 9).alias("sentiment"),
        "n_reviews",
        display.audience_label(sentiment.unit_range(F.col("sentiment"))).alias("audience"),
    )


@registered
def lexicon_accuracy(v: Views) -> DataFrame:
    label = (F.col("sentiment") == "positive").cast("int")
    sampled = sampling.sample_rows(v.labelled.withColumn("label", label), 250, ["review_id"])
    scores = sentiment.lexicon_scores(sampled, _lexicon(v), False)
    return sentiment.accuracy(sampled.drop("review").join(scores, "review_id")).select("n", "correct")


@registered
def sentiment_fallback(v: Views) -> DataFrame:
    """The toxicity label stands in for a classifier that knows some of the reviews only."""
    known = v.table("labels").where(F.col("toxic") == 1).select(
        F.col("doc_id").alias("review_id"), F.col("toxic").cast("double").alias("probability")
    )
    score = sentiment.sentiment_or_fallback(F.col("probability"), F.col("compound"))
    return (
        _scores(v)
        .join(known, "review_id", "left")
        .select("review_id", F.round(score, 5).alias("score"))
    )


def _scored_list(v: Views) -> DataFrame:
    """(userId, rank, title, hybrid_score): collaborative lists under their titles."""
    scaled = ensemble.normalise_scores(_collab(v), "score", digits=6)
    return scaled.join(v.movies.select("movieId", "title"), "movieId").select(
        "userId", "rank", "title", F.col("normalized_score").alias("hybrid_score")
    )


def _reranked(v: Views) -> DataFrame:
    heard = sentiment.audience(_scores(v), v.movies)
    return sentiment.rerank_with_sentiment(_scored_list(v), heard, digits=9)


@registered
def rerank_with_sentiment(v: Views) -> DataFrame:
    return _reranked(v)


@registered
def recommendation_tiles(v: Views) -> DataFrame:
    return report.recommendation_tiles(_reranked(v))


def _classifier(v: Views):
    rows = tables.clean_reviews(v.labelled)
    n_train = rows.count() * 3 // 4
    split = stage(
        sampling.train_validation_split(rows, ["review_id"], n_train, n_train), "classifier-split"
    )
    held_out = split.where(F.col("part") == "validation")
    return classifier.train_classifier(split.where(F.col("part") == "train")), held_out, rows


@registered
def classifier_scores(v: Views) -> DataFrame:
    model, _, rows = _classifier(v)
    scored = classifier.score_reviews(model, rows)
    return scored.select("review_id", F.round("probability", 4).alias("probability"), "label")


@registered
def classifier_accuracy(v: Views) -> DataFrame:
    model, held_out, _ = _classifier(v)
    return sentiment.accuracy(classifier.score_reviews(model, held_out), "probability", 0.5)


# --- explanations ----------------------------------------------------------------------


@registered
def genres_by_title(v: Views) -> DataFrame:
    """Genres of the first title that contains each seed title or each bare item name."""
    asked = v.movies.select("title").unionByName(v.metadata.select(F.col("raw_title").alias("title")))
    return explain.genres_by_title(asked, v.movies)


@registered
def explained(v: Views) -> DataFrame:
    recs = stage(_reranked(v), "reranked")
    tastes = profile.taste_profile(v.ratings, v.movies)
    return explain.explain_recommendations(recs, tastes, v.movies).select(
        "userId", "rank", "title", "explanation"
    )


@registered
def recommend(v: Views) -> DataFrame:
    """All users: hybrid lists, re-ranked by audience sentiment and explained."""
    return top.recommend(_models(v, True), _scores(v), min_votes=MIN_VOTES)


@registered
def word_attribution(v: Views) -> DataFrame:
    """The words that drive the classifier's probability, for every review."""
    model, _, _ = _classifier(v)
    words = v.reviews.select(F.explode(text.tokens(F.col("review"))).alias("word")).distinct()
    found = attribution.attribute_features(v.reviews, *classifier.word_pulls(model, words))
    return found.withColumn("weight", F.round("weight", 6))


@registered
def attribution_text(v: Views) -> DataFrame:
    """Summaries built from the lexicon words of each review, strongest first."""
    words = (
        v.reviews.select("review_id", F.explode(F.array_distinct(text.tokens(F.col("review")))).alias("word"))
        .join(_lexicon(v).select(F.col("token").alias("word"), F.col("valence").alias("weight")), "word")
    )
    order = [F.desc(F.abs("weight")), F.asc("word")]
    return attribution.attribution_summary(ranking.top_n(words, ["review_id"], order, attribution.N_WORDS))
