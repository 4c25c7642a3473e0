import pandas as pd

from marquee.operators import attribution, explain, profile, report

MOVIES = [
    (1, "Matrix, The (1999)", "Action|Sci-Fi"),
    (2, "Toy Story 2 (1999)", "Comedy|Animation"),
    (3, "Toy Story (1995)", "Animation|Children"),
    (4, "Heat (1995)", "Action|Crime"),
    (5, "Undated", ""),
]
RATINGS = [(1, 1, 5.0), (1, 4, 4.0), (1, 2, 3.5), (1, 99, 5.0), (2, 5, 4.5), (3, 98, 1.0)]


def frames(spark):
    movies = spark.createDataFrame(MOVIES, "movieId long, title string, genres string")
    return spark.createDataFrame(RATINGS, "userId long, movieId long, rating double"), movies


def test_taste_profile(spark):
    rows = {r.userId: r for r in profile.taste_profile(*frames(spark)).collect()}
    assert rows[1].top_genres == ["Action", "Crime", "Sci-Fi"]
    assert rows[1].top_decade == 1990 and rows[1].total_rated == 4
    assert rows[1].top_movies == ["Matrix, The (1999)", "Heat (1995)", "Toy Story 2 (1999)"]
    assert (rows[2].top_genres, rows[2].top_decade, rows[2].top_movies) == ([], None, ["Undated"])
    assert (rows[3].top_movies, rows[3].total_rated) == ([], 1)


def test_user_profile_and_card(spark):
    full = profile.user_profile(*frames(spark))
    rows = {r.userId: r for r in full.collect()}
    assert (rows[1].total_ratings, rows[1].avg_rating) == (4, 4.38)
    assert rows[1].genre_counts == {"Action": 2, "Animation": 1, "Comedy": 1, "Crime": 1, "Sci-Fi": 1}
    assert rows[1].decade_counts == {"1990s": 3} and rows[2].decade_counts == {"Unknown": 1}
    assert [t.title for t in rows[1].top_rated] == ["Matrix, The (1999)", "Heat (1995)", "Toy Story 2 (1999)"]
    assert (rows[3].genre_counts, rows[3].decade_counts, rows[3].top_rated) == ({}, {}, [])
    card = {r.userId: r for r in report.user_card(full).collect()}
    assert (card[1].top_genre, card[1].top_decade) == ("Action", "1990s")
    assert (card[3].top_genre, card[3].top_decade) == ("—", "—")
    assert card[1].titles[0].title == "Matrix, The" and card[1].titles[0].genres == "Action · Sci-Fi"
    one = spark.createDataFrame([(1,), (77,)], "userId long")
    assert [r.userId for r in profile.user_profile(*frames(spark), users=one).collect()] == [1]


def test_genres_of_the_first_title_containing_the_name(spark):
    _, movies = frames(spark)
    names = ["Toy Story (1995)", "MATRIX, the", "oy st", "Nope", " (1999)"]
    asked = spark.createDataFrame([(n,) for n in names], "title string")
    got = {r.title: r.genres for r in explain.genres_by_title(asked, movies).collect()}
    assert got == {
        "Toy Story (1995)": "Comedy|Animation",  # item 2 comes first and contains the name
        "MATRIX, the": "Action|Sci-Fi",
        "oy st": "Comedy|Animation",
        " (1999)": "Action|Sci-Fi",  # nothing left but '': the first item
    }


def test_reasons_in_order(spark):
    ratings, movies = frames(spark)
    recs = [
        (1, 1, "The Matrix (1999)", 0.82),
        (1, 2, "Heat (1995)", 0.70),
        (1, 3, "Quiet Sea (2010)", 0.91),
        (1, 4, "Long Walk (2024)", 0.61),
        (1, 5, "Plain (2024)", 0.5),
        (2, 1, "Plain (2024)", 0.5),
        (3, 1, "Plain (2024)", 0.6),
    ]
    df = spark.createDataFrame(recs, "userId long, rank int, title string, sentiment_score double")
    got = explain.explain_recommendations(df, profile.taste_profile(ratings, movies), movies)
    text = {(r.userId, r["rank"]): r.explanation for r in got.collect()}
    assert text == {
        (1, 1): "From the 1990s — your favourite era · Audiences absolutely loved this film",
        (1, 2): "Matches your love of Action & Crime · From the 1990s — your favourite era",
        (1, 3): "Audiences absolutely loved this film · Because you liked Matrix, The",
        (1, 4): "Consistently strong audience reception · Because you liked Matrix, The",
        (1, 5): "Because you liked Matrix, The",
        (2, 1): "Because you liked Undated",
        (3, 1): "Highly rated by users with similar taste to you",
    }


def test_tiles(spark):
    recs = spark.createDataFrame(
        [(1, 1, "A (1999)", 0.8, 0.71), (1, 2, "B", 0.2, 0.41), (1, 3, "C", 0.1, None)],
        "userId long, rank int, title string, final_score double, sentiment_score double",
    )
    rows = report.recommendation_tiles(recs).orderBy("rank").collect()
    assert [(r.title, r.percent, r.audience) for r in rows] == [("A", 100, "Loved"), ("B", 25, "Liked"), ("C", 12, "Liked")]


def test_attribution_recovers_a_linear_scorer(spark):
    weights = {"masterpiece": 4.0, "incredible": 2.0, "dull": -3.0}

    def linear(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sum(w for word, w in weights.items() if word in t))

    review = "What a masterpiece of a story , incredible at first , though it turns dull near the end"
    df = spark.createDataFrame([(1, review), (2, None), (3, ""), (4, "dull")], "review_id long, review string")
    found = attribution.attribute_words(df, linear)
    rows = found.where("review_id = 1").orderBy("rank").collect()
    assert [r.word for r in rows][:3] == ["masterpiece", "dull", "incredible"] and len(rows) == 8
    assert [r.weight > 0 for r in rows][:3] == [True, False, True]
    assert set(r.review_id for r in found.collect()) == {1, 4}
    same = attribution.attribute_words(df.repartition(3), linear).where("review_id = 1").orderBy("rank").collect()
    assert rows == same


def test_attribution_summary(spark):
    rows = [(1, i, w, s) for i, (w, s) in enumerate([("a", 3.0), ("b", -2.0), ("c", 1.0), ("d", 0.9), ("e", 0.8), ("f", 0.1)], 1)]
    rows += [(2, 1, "x", 0.0)]
    df = spark.createDataFrame(rows, "review_id long, rank int, word string, weight double")
    got = {r.review_id: r.summary for r in attribution.attribution_summary(df).collect()}
    assert got == {1: "Positive signals: a, c, d, e | Negative signals: b", 2: "No clear signals found"}


def test_names_are_found_by_their_rarest_trigram(spark):
    import random

    random.seed(2)
    titles = ["".join(random.choice("abcé ") for _ in range(random.randint(0, 9))) for _ in range(120)]
    movies = spark.createDataFrame([(i, t, f"g{i}") for i, t in enumerate(titles)] + [(500, None, "x")], "movieId long, title string, genres string")
    names = ["", "a", "É", "zz", "zzz"] + ["".join(random.choice("abcÉ ") for _ in range(random.randint(1, 5))) for _ in range(80)]
    got = {r.title: r.genres for r in explain.genres_by_title(spark.createDataFrame([(n,) for n in names], "title string"), movies).collect()}
    want = {}
    for n in names:
        hits = [i for i, t in enumerate(titles) if n.lower() in t]
        if hits:
            want[n] = f"g{hits[0]}"
    assert got == want


def test_a_film_of_the_catalogue_has_its_own_genres(spark):
    ratings, movies = frames(spark)
    recs = spark.createDataFrame([(1, 1, "Toy Story (1995)", 0.5, 3), (1, 2, "Heat", 0.4, None)], "userId long, rank int, title string, hybrid_score double, movieId long")
    profiles = spark.createDataFrame([(1, ["Children", "Crime"], None, [])], "userId long, top_genres array<string>, top_decade int, top_movies array<string>")
    rows = {r.title: r.explanation for r in explain.explain_recommendations(recs, profiles, movies).collect()}
    assert rows == {"Toy Story (1995)": "Matches your love of Children", "Heat": "Matches your love of Crime"}


def test_a_text_that_the_scorer_fails_on_has_one_row(spark):
    def moody(texts: pd.Series) -> pd.Series:
        if texts.str.contains("boom").any():
            raise RuntimeError("no score")
        return texts.map(lambda t: float("nan") if "void" in t else t.count("good"))

    df = spark.createDataFrame([(1, "a good film"), (2, "it goes boom"), (3, "void of sense"), (4, "good , good !")], "review_id long, review string")
    found = attribution.attribute_words(df.coalesce(1), moody).orderBy("review_id", "rank").collect()
    assert [tuple(r) for r in found if r.review_id in (2, 3)] == [(i, 1, attribution.UNAVAILABLE, 0.0) for i in (2, 3)]
    assert [r.word for r in found if r.review_id == 1][0] == "good" and [r.word for r in found if r.review_id == 4] == ["good"]


def test_additive_classifier_words_equal_its_masked_texts(spark):
    import math

    pulls = {"masterpiece": 1.5, "dull": -2.0, "near": 0.3}
    review = "What a masterpiece of a story , MASTERPIECE at first , though dull near the end"
    df = spark.createDataFrame([(1, review), (2, None), (3, "?"), (4, "dull")], "review_id long, review string")
    table = spark.createDataFrame(list(pulls.items()), "word string, pull double")
    rows = attribution.attribute_features(df, table, 0.2).orderBy("review_id", "rank").collect()

    def score(texts: pd.Series) -> pd.Series:
        total = texts.map(lambda t: sum(pulls.get(w, 0.0) for w in t.split()))
        return total.map(lambda m: 1 / (1 + math.exp(-(0.2 + m))))

    # one-letter words aren't the classifier's; without them both ways have the same words and masks
    plain = " ".join(w for w in review.lower().split() if len(w) > 1)
    by_text = attribution.attribute_words(spark.createDataFrame([(1, plain)], "review_id long, review string"), score).orderBy("rank").collect()
    mine = [r for r in rows if r.review_id == 1]
    assert [(r.word, round(r.weight, 9)) for r in mine] == [(r.word, round(r.weight, 9)) for r in by_text]
    assert {r.review_id for r in rows} == {1, 4} and [r.word for r in mine][:2] == ["masterpiece", "dull"]


def test_pulls_of_words_add_up_to_the_margin(spark):
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from marquee.operators import classifier

    train = spark.createDataFrame([(f"good fine text {i}", 1) for i in range(8)] + [(f"bad poor text {i}", 0) for i in range(8)], "review string, label int")
    model = classifier.train_classifier(train, 64)
    words = spark.createDataFrame([("good",), ("text",), ("poor",)], "word string")
    table, intercept = classifier.word_pulls(model, words)
    pull = {r.word: r.pull for r in table.collect()}
    text = spark.createDataFrame([("good text poor poor",)], "review string")
    margin = model.transform(text).select(vector_to_array(F.col("rawPrediction"))[1]).first()[0]
    assert abs(margin - (intercept + pull["good"] + pull["text"] + 2 * pull["poor"])) < 1e-9


def test_masks_hide_the_least_draws_without_ranking_all(spark):
    from time import perf_counter

    import numpy as np

    def ranked(n_words, review_id):
        rng = np.random.default_rng([0, review_id])
        place = rng.random((100, n_words)).argsort(axis=1).argsort(axis=1)
        hidden = rng.integers(1, n_words + 1, 100)
        hidden[0] = 0
        return (place >= hidden[:, None]).astype(float)

    def least(draw):
        times = []
        for i in range(30):
            start = perf_counter()
            draw(300, i)
            times.append(perf_counter() - start)
        return min(times)

    mine = lambda n, i: attribution._masks(n, 100, 0, i)
    assert all((mine(n, i) == ranked(n, i)).all() for n in (1, 2, 40) for i in range(5))
    assert least(mine) < 0.75 * least(ranked)
