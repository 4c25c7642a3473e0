"""The registered queries as SQL over the same tables, written from the definitions."""

from __future__ import annotations

from marquee.operators.sentiment import NEGATIONS, STRONGER, WEAKER
from marquee.plans.views import LEXICON, MOST_RATED, STOP_WORDS

RATINGS = """ratings AS (
  SELECT o_custkey AS userId, l_partkey AS movieId, ceil(l_quantity / 5) / 2 AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

MOVIES = """movies AS (
  SELECT p_partkey AS movieId, concat(p_name, ' ', p_partkey, ' (', 1950 + p_size, ')') AS title,
         concat(p_type, '|', p_brand) AS genres
  FROM part)"""

METADATA = """metadata AS (
  SELECT p_partkey AS id, concat(p_name, ' ', p_partkey) AS title, p_name AS raw_title,
         concat(p_type, ' ', p_brand) AS genre_names, coalesce(text, '') AS overview,
         concat(1950 + p_size, '-01-01') AS release_date, coalesce(n, 0)::DOUBLE AS vote_count,
         coalesce(lang, 'en') AS original_language,
         concat(replace(p_name, ' ', ''), ' size', p_size) AS keyword_names,
         concat('Ann', p_type, ' Bo', p_size % 7, ' Cy') AS cast_names,
         concat('Dir', p_partkey % 97) AS director_name
  FROM part LEFT JOIN documents ON p_partkey = doc_id
  LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey)"""

REVIEWS = """reviews AS (
  SELECT doc_id AS review_id, doc_id % 50 AS movieId, text AS review,
         CASE WHEN quality = 1 THEN 'positive' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'negative' END AS sentiment
  FROM documents LEFT JOIN labels USING (doc_id))"""

LABELLED = "labelled AS (SELECT * FROM {} WHERE sentiment IS NOT NULL)"

RATED = "rated AS (SELECT * FROM ratings JOIN movies USING (movieId))"

DENSE = """popular AS (SELECT movieId FROM ratings GROUP BY movieId HAVING count(*) >= 20),
kept AS (SELECT * FROM ratings WHERE movieId IN (SELECT movieId FROM popular)),
active AS (SELECT userId FROM kept GROUP BY userId HAVING count(*) >= 20),
dense AS (SELECT * FROM kept WHERE userId IN (SELECT userId FROM active))"""

MATRIX = "matrix AS (SELECT userId, movieId, avg(rating) AS rating FROM dense GROUP BY userId, movieId)"

NEIGHBOURS = """norms AS (SELECT userId, sqrt(sum(rating * rating)) AS norm FROM matrix GROUP BY userId),
cosines AS (
  SELECT a.userId, b.userId AS neighbour, sum(a.rating * b.rating) AS dot
  FROM matrix a JOIN matrix b ON a.movieId = b.movieId AND a.userId <> b.userId
  GROUP BY a.userId, b.userId),
similar_users AS (
  SELECT c.userId, neighbour, round(dot / (n1.norm * n2.norm), 9) AS similarity
  FROM cosines c JOIN norms n1 ON c.userId = n1.userId JOIN norms n2 ON neighbour = n2.userId),
neighbours AS (
  SELECT *, row_number() OVER (PARTITION BY userId ORDER BY similarity DESC, neighbour) AS rank
  FROM similar_users QUALIFY rank <= 20)"""

COLLAB = """liked AS (SELECT * FROM dense WHERE rating >= 4),
scored AS (
  SELECT n.userId, l.movieId, sum(l.rating) AS score
  FROM neighbours n JOIN liked l ON n.neighbour = l.userId GROUP BY n.userId, l.movieId),
fresh AS (
  SELECT * FROM scored s
  WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.userId = s.userId AND r.movieId = s.movieId))"""


def collab(n: int) -> str:
    return f"""{COLLAB},
collab AS (
  SELECT *, row_number() OVER (PARTITION BY userId ORDER BY score DESC, movieId) AS rank
  FROM fresh QUALIFY rank <= {n})"""


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def split_genres(column: str) -> str:
    trimmed = f"list_transform(string_split({column}, '|'), lambda g: trim(g))"
    return f"list_filter({trimmed}, lambda g: g <> '' AND g <> 'nan')"


# The same character classes as the Spark side uses.
WS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD = r"\p{L}\p{N}_"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def lower_strip(x: str) -> str:
    return strip(f"lower(coalesce({x}, ''))")


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{WS}]+')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[{WORD}]{{2,}}')"


def normalise(x: str) -> str:
    bare = f"regexp_replace(lower({x}), '[^{WORD}{WS}]', '', 'g')"
    return f"array_to_string(list_filter({words(bare)}, lambda w: w NOT IN ('the', 'a', 'an')), ' ')"


def yearless(x: str) -> str:
    return rf"regexp_replace({x}, '[{WS}]*\([0-9]{{4}}\)[{WS}]*$', '')"


def lookup(x: str) -> str:
    base = strip(yearless(x))
    the = f"CASE WHEN contains({base}, ', The') THEN concat('The ', replace({base}, ', The', '')) ELSE {base} END"
    return f"CASE WHEN contains({the}, ', A ') THEN concat('A ', replace({the}, ', A ', ' ')) ELSE {the} END"


def clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '[{WS}]+', ' ', 'g'))"


def year(x: str) -> str:
    return rf"try_cast(nullif(regexp_extract({x}, '\(([0-9]{{4}})\)', 1), '') AS INTEGER)"


def decade_label(x: str) -> str:
    return f"CASE WHEN {year(x)} IS NULL THEN 'Unknown' ELSE concat({year(x)} // 10 * 10, 's') END"


def category(x: str) -> str:
    # The same rules as the Spark side's display categories.
    rules = [
        ("action", "action|thriller"),
        ("comedy", "comedy"),
        ("romance", "romance"),
        ("horror", "horror"),
        ("family", "animation|family"),
        ("fantastic", "sci|fantasy"),
        ("drama", "drama"),
        ("crime", "crime"),
        ("documentary", "documentary"),
        ("music", "music"),
    ]
    whens = " ".join(f"WHEN regexp_matches(lower({x}), '{needle}') THEN '{name}'" for name, needle in rules)
    return f"CASE {whens} ELSE 'other' END"


def quoted(values) -> str:
    return ", ".join("'" + value.replace("'", "''") + "'" for value in values)


LEX = "lexicon(token, valence) AS (VALUES " + ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in LEXICON) + ")"

SOUP = """soup AS (
  SELECT *, concat_ws(' ', genre_names, genre_names, genre_names, keyword_names, keyword_names,
                      director_name, director_name, cast_names, overview) AS soup
  FROM metadata)"""

ITEMS = f"items AS (SELECT * FROM soup WHERE len({words('soup')}) >= 10)"

TERMS = f"""kept_words AS (
  SELECT id, list_filter({tokens('soup')}, lambda t: t NOT IN ({quoted(STOP_WORDS)})) AS ws FROM items),
places AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS at FROM kept_words),
grams AS (
  SELECT id, w AS term FROM places
  UNION ALL
  SELECT a.id, concat(a.w, ' ', b.w) FROM places a JOIN places b ON a.id = b.id AND b.at = a.at + 1),
counts AS (SELECT id, term, count(*) AS n FROM grams GROUP BY id, term),
vocabulary AS (
  SELECT term, row_number() OVER (ORDER BY sum(n) DESC, term) AS dim, sum(n)::BIGINT AS total, count(*) AS df,
         ln((1 + (SELECT count(*) FROM items)) / (1 + count(*))) + 1 AS idf
  FROM counts GROUP BY term QUALIFY dim <= 15000),
raw_weights AS (SELECT id, dim, c.term, n * idf AS w FROM counts c JOIN vocabulary v ON c.term = v.term),
weights AS (
  SELECT id, dim, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw_weights)"""


SIMILAR = """products AS (
  SELECT a.id AS seed, b.id, sum(a.weight * b.weight) AS cos
  FROM weights a JOIN weights b ON a.dim = b.dim AND a.id <> b.id GROUP BY a.id, b.id),
blended AS (
  SELECT s.id AS seed, i.id,
         round(0.65 * coalesce(cos, 0) + 0.35 * (i.vote_count / (SELECT max(vote_count) FROM items)), 9) AS score
  FROM items s JOIN items i ON s.id <> i.id LEFT JOIN products p ON p.seed = s.id AND p.id = i.id),
shown AS (
  SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS position, id, score, title,
         genre_names, vote_count, original_language
  FROM blended JOIN items USING (id) WHERE score >= 0.1 AND vote_count >= 20)"""


SCORED_LIST = """scaled AS (
  SELECT userId, movieId, rank, score, round((score - min(score) OVER u)
         / CASE WHEN max(score) OVER u = min(score) OVER u THEN 1 ELSE max(score) OVER u - min(score) OVER u END, 6)
         AS normalized_score
  FROM collab WINDOW u AS (PARTITION BY userId)),
scored_list AS (
  SELECT userId, rank, title, normalized_score AS hybrid_score FROM scaled JOIN movies USING (movieId))"""

CORE = f"""spoken AS (
  SELECT review_id, unnest({words('review')}) AS said FROM reviews),
bare AS (
  SELECT review_id, said, regexp_replace(said, '^\\p{{P}}+|\\p{{P}}+$', '', 'g') AS stripped FROM spoken),
hits AS (
  SELECT review_id, sum(valence) AS total
  FROM bare JOIN lexicon ON token = lower(CASE WHEN length(stripped) > 2 THEN stripped ELSE said END)
  GROUP BY review_id),
scores AS (
  SELECT review_id, movieId, sentiment,
         round(round(coalesce(total, 0), 9) / sqrt(round(coalesce(total, 0), 9) ** 2 + 15), 6) AS compound
  FROM reviews LEFT JOIN hits USING (review_id))"""



def neighbour_step(before: str, loud: str, value: str, damping: float) -> str:
    """The value after one preceding word has strengthened, weakened or negated it."""
    step = f"CASE WHEN {before} IN ({quoted(STRONGER)}) THEN 0.293 WHEN {before} IN ({quoted(WEAKER)}) THEN -0.293 ELSE 0 END"
    raised = f"CASE WHEN mixed AND {loud} AND {before} IN ({quoted(STRONGER)}, {quoted(WEAKER)}) THEN 0.733 ELSE 0 END"
    negated = f"CASE WHEN {before} IN ({quoted(NEGATIONS)}) THEN -0.74 ELSE 1 END"
    return f"({value} + sign({value}) * ({step} + {raised})::DOUBLE * {damping}) * {negated}"


RULES = rf"""split AS (
  SELECT doc_id, ws, unnest(ws) AS said, generate_subscripts(ws, 1) AS place
  FROM (SELECT doc_id, {words('text')} AS ws FROM documents)),
said AS (
  SELECT doc_id, place, said, regexp_matches(said, '^[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*$') AS loud,
         regexp_replace(said, '^\p{{P}}+|\p{{P}}+$', '', 'g') AS bare FROM split),
told AS (
  SELECT doc_id, place, loud, said, lower(CASE WHEN length(bare) > 2 THEN bare ELSE said END) AS word FROM said),
around AS (
  SELECT *, lag(word, 1, '') OVER p AS b1, lag(word, 2, '') OVER p AS b2, lag(word, 3, '') OVER p AS b3,
         lag(loud, 1, false) OVER p AS l1, lag(loud, 2, false) OVER p AS l2, lag(loud, 3, false) OVER p AS l3,
         bool_or(loud) OVER d AND bool_or(NOT loud) OVER d AS mixed,
         coalesce(min(CASE WHEN regexp_matches(said, '^(?i)\p{{P}}*but\p{{P}}*$') THEN place END) OVER d, 0) AS but
  FROM told WINDOW p AS (PARTITION BY doc_id ORDER BY place), d AS (PARTITION BY doc_id)),
v0 AS (
  SELECT *, (valence + CASE WHEN mixed AND regexp_matches(said, '^[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*$')
                            THEN sign(valence) * 0.733 ELSE 0 END)::DOUBLE AS v
  FROM around JOIN lexicon ON token = word
  WHERE word NOT IN ({quoted(STRONGER)}, {quoted(WEAKER)})),
v1 AS (SELECT * REPLACE (({neighbour_step('b1', 'l1', 'v', 1.0)})::DOUBLE AS v) FROM v0),
v2 AS (SELECT * REPLACE (({neighbour_step('b2', 'l2', 'v', 0.95)})::DOUBLE AS v) FROM v1),
v3 AS (SELECT * REPLACE (({neighbour_step('b3', 'l3', 'v', 0.9)})::DOUBLE AS v) FROM v2),
sums AS (
  SELECT doc_id, round(sum(v * CASE WHEN but = 0 OR place = but THEN 1.0 WHEN place < but THEN 0.5 ELSE 1.5 END), 9)
         AS total
  FROM v3 GROUP BY doc_id),
marks AS (
  SELECT doc_id, coalesce(total, 0) AS total, least(length(regexp_replace(text, '[^!]', '', 'g')), 4) * 0.292::DOUBLE
         + CASE WHEN length(regexp_replace(text, '[^?]', '', 'g')) > 3 THEN 0.96::DOUBLE
                WHEN length(regexp_replace(text, '[^?]', '', 'g')) > 1
                THEN length(regexp_replace(text, '[^?]', '', 'g')) * 0.18::DOUBLE ELSE 0 END AS emphasis
  FROM documents LEFT JOIN sums USING (doc_id)),
ruled AS (SELECT doc_id, total + sign(total) * emphasis AS total FROM marks)"""

RERANKED = f"""heard AS (
  SELECT lower({lookup('title')}) AS key, (sum(compound) / count(*) + 1) / 2 AS audience
  FROM scores JOIN movies USING (movieId) GROUP BY key),
blend AS (
  SELECT userId, title, hybrid_score, coalesce(audience, 0.5) AS heard,
         round(hybrid_score * (1 - 0.2) + coalesce(audience, 0.5) * 0.2, 9) AS final
  FROM scored_list LEFT JOIN heard ON lower({lookup('title')}) = key),
reranked AS (
  SELECT userId, row_number() OVER (PARTITION BY userId ORDER BY final DESC, title) AS rank, title,
         hybrid_score, round(heard, 9) AS sentiment_score, final AS final_score
  FROM blend)"""

TASTE = f"""liked_genres AS (
  SELECT userId, genre, row_number() OVER (PARTITION BY userId ORDER BY count(*) DESC, genre) AS place
  FROM (SELECT userId, unnest({split_genres('genres')}) AS genre FROM rated WHERE rating >= 4)
  GROUP BY userId, genre QUALIFY place <= 5),
liked_decades AS (
  SELECT userId, decade, row_number() OVER (PARTITION BY userId ORDER BY count(*) DESC, decade) AS place
  FROM (SELECT userId, {year('title')} // 10 * 10 AS decade FROM rated WHERE rating >= 4 AND {year('title')} > 0)
  GROUP BY userId, decade QUALIFY place = 1),
best_titles AS (
  SELECT userId, title, row_number() OVER (PARTITION BY userId ORDER BY rating DESC, movieId, title) AS place
  FROM rated QUALIFY place <= 5),
taste AS (
  SELECT t.userId, g.names AS top_genres, d.decade AS top_decade, b.names AS top_movies, t.n AS total_rated
  FROM (SELECT userId, count(*) AS n FROM ratings GROUP BY userId) t
  LEFT JOIN (SELECT userId, list(genre ORDER BY place) AS names FROM liked_genres GROUP BY userId) g USING (userId)
  LEFT JOIN liked_decades d USING (userId)
  LEFT JOIN (SELECT userId, list(title ORDER BY place) AS names FROM best_titles GROUP BY userId) b USING (userId))"""

CAPITALISED = """array_to_string(list_transform(string_split({x}, ' '),
  lambda w: concat(upper(left(w, 1)), substr(w, 2))), ' ')"""

ODD_TITLES = f"""odd AS (
  SELECT p_partkey AS movieId, CASE p_partkey % 6
    WHEN 0 THEN concat(name, ', The (', 1950 + p_size, ')')
    WHEN 1 THEN concat(name, ', A Tale (', 1950 + p_size, ') ')
    WHEN 2 THEN concat(' The  ', p_name, '''s: an Élan!')
    WHEN 3 THEN concat(p_name, ' (', 1950 + p_size, ') ', p_partkey)
    WHEN 4 THEN concat(chr(160), upper(p_name), '_a-', p_size, chr(9))
    ELSE concat(p_name, ' ', p_partkey, ' (', 1950 + p_size, ')') END AS title
  FROM (SELECT *, {CAPITALISED.format(x='p_name')} AS name FROM part))"""

VOTE_BEST = "arg_max(id, (vote_count, -id))"


def shuffled(table: str, seed: int, *keys: str) -> str:
    parts = ", ".join(f"({k})::VARCHAR" for k in keys)
    return f"""shuffled AS (
  SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', {parts}))) AS position FROM {table})"""


def merged(lists: str, n: int = 10) -> str:
    """Scale, weight, add up and cut the rows of ``lists(source, weight, userId, title, score)``."""
    return f"""parts AS (
  SELECT userId, title, weight * round((score - min(score) OVER u)
         / CASE WHEN max(score) OVER u = min(score) OVER u THEN 1 ELSE max(score) OVER u - min(score) OVER u END, 4)
         AS part
  FROM {lists} WINDOW u AS (PARTITION BY source, userId)),
summed AS (SELECT userId, title, round(sum(part), 9) AS total FROM parts GROUP BY userId, title),
unseen AS (
  SELECT * FROM summed s
  WHERE NOT EXISTS (SELECT 1 FROM rated r WHERE r.userId = s.userId AND r.title = s.title)),
hybrid AS (
  SELECT userId, row_number() OVER (PARTITION BY userId ORDER BY total DESC, title) AS rank, title,
         round(total, 6) AS hybrid_score
  FROM unseen QUALIFY rank <= {n})"""


def source_queries() -> dict[str, str]:
    dirty = """clean AS (
  SELECT id, title, release_date, original_language,
         CASE WHEN id % 13 = 0 THEN '' ELSE genre_names END AS genre_names,
         CASE WHEN id % 17 = 0 THEN 0 ELSE vote_count END AS vote_count,
         CASE WHEN p_size <= 35 THEN keyword_names ELSE '' END AS keyword_names,
         CASE WHEN p_type <> 'MEDIUM' THEN cast_names ELSE '' END AS cast_names,
         CASE WHEN p_type <> 'MEDIUM' AND id % 5 <> 2 THEN director_name ELSE '' END AS director_name
  FROM metadata JOIN part ON p_partkey = id WHERE id % 11 <> 5)"""
    return {
        "load_report": query(
            RATINGS,
            MOVIES,
            METADATA,
            REVIEWS,
            select="""SELECT 'ratings' AS source, count(*) AS n_rows, 3 AS n_columns FROM ratings
UNION ALL SELECT 'movies', count(*), 3 FROM movies
UNION ALL SELECT 'metadata', count(*), 12 FROM metadata
UNION ALL SELECT 'reviews', count(*), 4 FROM reviews""",
        ),
        "metadata_from_literals": query(METADATA, dirty, select="SELECT * FROM clean"),
        "metadata_from_csv": query(
            METADATA, dirty, select="SELECT * EXCLUDE (release_date, original_language) FROM clean"
        ),
        "ratings_from_csv": query(
            RATINGS,
            MOVIES,
            RATED,
            select="""SELECT movieId, title, genres, count(*) AS n, sum(rating) AS total
FROM rated GROUP BY movieId, title, genres""",
        ),
        "rating_sample": query(
            RATINGS,
            """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY userId, movieId, rating) AS copy_no FROM ratings)""",
            shuffled("numbered", 42, "userId", "movieId", "rating", "copy_no"),
            select="""SELECT userId, movieId, rating, count(*) AS copies
FROM shuffled WHERE position <= 5000 GROUP BY userId, movieId, rating""",
        ),
        "train_validation_split": query(
            REVIEWS,
            LABELLED.format("reviews"),
            shuffled("labelled", 42, "review_id"),
            select="""SELECT review_id, CASE WHEN position <= 200 THEN 'train' ELSE 'validation' END AS part
FROM shuffled WHERE position <= 300""",
        ),
        "reviews_cleaned": query(
            REVIEWS,
            select=f"""SELECT review_id, movieId, {clean('review')} AS review,
  CASE WHEN sentiment = 'positive' THEN 1 ELSE 0 END AS label FROM reviews""",
        ),
        "pages_cleaned": f"SELECT page_id, {clean('html')} AS review FROM pages",
        "class_counts": query(
            REVIEWS,
            LABELLED.format("reviews"),
            select="SELECT sentiment, count(*) AS n FROM labelled GROUP BY sentiment",
        ),
    }


def function_queries() -> dict[str, str]:
    return {
        "title_functions": query(
            ODD_TITLES,
            select=f"""SELECT movieId, CASE WHEN regexp_matches(title, '[^\\x00-\\x7F]') THEN 'hi' END AS lang,
  {lower_strip('title')} AS title_lower, {normalise('title')} AS title_norm, {yearless('title')} AS yearless,
  {lookup('title')} AS lookup, {year('title')} AS year, {decade_label('title')} AS decade,
  array_to_string(list_sort({words('lower(title)')}), ' ') AS sorted_words
FROM odd""",
        ),
        "documents_normalised": f"""SELECT doc_id, {normalise('text')} AS normalised,
  CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 'hi' END AS lang_rule, len({tokens('text')}) AS n_tokens
FROM documents""",
        "request_filters": """SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'es' THEN 'es' END AS lang,
  CASE WHEN doc_id % 3 <> 0 THEN source END AS genre FROM documents""",
        "genre_labels": f"""SELECT doc_id, {category('text')} AS category, concat(lang, ' · ', source) AS shown
FROM documents""",
    }


def profile_queries() -> dict[str, str]:
    genre_rows = f"""genre_rows AS (
  SELECT userId, rating, unnest({split_genres('genres')}) AS genre FROM rated)"""
    profile = f"""genre_n AS (SELECT userId, genre, count(*) AS n FROM genre_rows GROUP BY userId, genre),
decade_n AS (
  SELECT userId, decade, count(*) AS n
  FROM (SELECT userId, {decade_label('title')} AS decade FROM rated) GROUP BY userId, decade),
best AS (
  SELECT *, row_number() OVER (PARTITION BY userId ORDER BY rating DESC, movieId, title) AS rank
  FROM rated QUALIFY rank <= 10),
totals AS (
  SELECT userId, count(*) AS total_ratings, round(avg(rating), 6) AS avg_rating FROM ratings GROUP BY userId)"""
    base = (RATINGS, MOVIES, RATED, genre_rows)
    return {
        "user_totals": query(
            RATINGS,
            select="""SELECT userId, count(*) AS total_ratings, round(avg(rating), 6) AS avg_rating
FROM ratings GROUP BY userId""",
        ),
        "genre_counts": query(
            *base, select="SELECT userId, genre, count(*) AS n FROM genre_rows GROUP BY userId, genre"
        ),
        "liked_genre_counts": query(
            *base,
            select="SELECT userId, genre, count(*) AS n FROM genre_rows WHERE rating >= 4 GROUP BY userId, genre",
        ),
        "decade_counts": query(*base, profile, select="SELECT userId, decade, n FROM decade_n"),
        "top_rated": query(*base, profile, select="SELECT userId, rank, title, rating, genres FROM best"),
        "user_profile": query(
            *base,
            profile,
            select="""SELECT userId, total_ratings, avg_rating, coalesce(g, '') AS genre_counts,
  coalesce(d, '') AS decade_counts, coalesce(b, '') AS top_rated
FROM totals
LEFT JOIN (SELECT userId, string_agg(concat(genre, '=', n), ';' ORDER BY genre) AS g FROM genre_n GROUP BY userId)
  USING (userId)
LEFT JOIN (SELECT userId, string_agg(concat(decade, '=', n), ';' ORDER BY decade) AS d FROM decade_n GROUP BY userId)
  USING (userId)
LEFT JOIN (SELECT userId, string_agg(concat(title, '=', rating * 2, '=', genres), ';' ORDER BY rank) AS b
           FROM best GROUP BY userId) USING (userId)""",
        ),
        "taste_profile": query(
            RATINGS,
            MOVIES,
            RATED,
            TASTE,
            select="""SELECT userId, coalesce(array_to_string(top_genres, ';'), '') AS top_genres, top_decade,
  coalesce(array_to_string(top_movies, ';'), '') AS top_movies, total_rated FROM taste""",
        ),
        "user_card": query(
            *base,
            profile,
            select=f"""SELECT userId, total_ratings, avg_rating, coalesce(g[1], '—') AS top_genre,
  coalesce(d1, '—') AS top_decade, array_to_string(g[1:8], ';') AS leading_genres, d AS decades, b AS titles
FROM totals
LEFT JOIN (SELECT userId, list(genre ORDER BY n DESC, genre) AS g FROM genre_n GROUP BY userId) USING (userId)
LEFT JOIN (SELECT userId, string_agg(decade, ';' ORDER BY decade) AS d,
                  (list(decade ORDER BY n DESC, decade))[1] AS d1 FROM decade_n GROUP BY userId) USING (userId)
LEFT JOIN (SELECT userId, string_agg(concat({strip(yearless('title'))}, '=', {category('genres')}, '=',
                  replace(genres, '|', ' · ')), ';' ORDER BY rank) AS b
           FROM best WHERE rank <= 8 GROUP BY userId) USING (userId)""",
        ),
    }


def collab_queries() -> dict[str, str]:
    base = (RATINGS, DENSE, MATRIX)
    return {
        "collab_matrix": query(*base, select="SELECT userId, movieId, round(rating, 6) AS rating FROM matrix"),
        "collab_shape": query(
            RATINGS,
            DENSE,
            select="SELECT count(DISTINCT userId) AS n_users, count(DISTINCT movieId) AS n_movies FROM dense",
        ),
        "user_neighbours": query(
            *base,
            NEIGHBOURS,
            select="SELECT userId, rank, neighbour, similarity FROM neighbours",
        ),
        "collab_recommendations": query(
            *base, NEIGHBOURS, collab(10), select="SELECT userId, rank, movieId, score FROM collab"
        ),
        "normalised_scores": query(
            *base,
            NEIGHBOURS,
            collab(10),
            MOVIES,
            SCORED_LIST,
            select="SELECT userId, rank, movieId, score, normalized_score FROM scaled",
        ),
    }


def content_queries() -> dict[str, str]:
    model = (METADATA, SOUP, ITEMS, TERMS)
    return {
        "content_soup": query(
            METADATA,
            SOUP,
            select=f"SELECT id, soup, vote_count FROM soup WHERE len({words('soup')}) >= 16",
        ),
        "search_table": query(
            METADATA,
            select=f"""SELECT id, title, release_date, genre_names, vote_count, {lower_strip('title')} AS title_lower,
  left(release_date, 4) AS year FROM metadata""",
        ),
        "vocabulary": query(
            *model, select="SELECT term, dim, total, df, round(idf, 6) AS idf FROM vocabulary"
        ),
        "tfidf_weights": query(*model, select="SELECT id, term, round(weight, 6) AS weight FROM weights"),
        "similar_items": query(
            *model,
            SIMILAR,
            select="""SELECT seed AS seed_id, row_number() OVER (PARTITION BY seed ORDER BY position) AS rank, id,
  score FROM shown QUALIFY rank <= 10""",
        ),
        "similar_filtered": query(
            *model,
            SIMILAR,
            select="""SELECT seed AS seed_id, row_number() OVER (PARTITION BY seed ORDER BY position) AS rank,
  n.title, n.genre_names, score AS similarity_score, n.vote_count::BIGINT AS vote_count,
  n.original_language
FROM shown n JOIN items s ON s.id = n.seed
WHERE contains(lower(n.genre_names), lower(split_part(s.genre_names, ' ', 1)))
  AND (s.id % 2 <> 0 OR n.original_language = s.original_language)
QUALIFY rank <= 20""",
        ),
        "similar": query(
            *model,
            SIMILAR,
            MOVIES,
            select=f"""SELECT movieId AS request_id, row_number() OVER (PARTITION BY movieId ORDER BY position) AS rank,
  n.title, n.genre_names, score AS similarity_score, n.vote_count::BIGINT AS vote_count,
  n.original_language
FROM movies m JOIN items s ON lower(s.title) = lower({lookup('m.title')}) JOIN shown n ON s.id = n.seed
QUALIFY rank <= 10""",
        ),
    }


def title_queries() -> dict[str, str]:
    return {
        "resolve_titles": query(
            METADATA,
            """asked AS (
  SELECT DISTINCT CASE id % 3 WHEN 0 THEN concat(' ', upper(title)) WHEN 1 THEN concat('The ', title, '!')
         ELSE concat(title, ' returns') END AS title FROM metadata)""",
            f"exact AS (SELECT {lower_strip('title')} AS key, {VOTE_BEST} AS id FROM metadata GROUP BY key)",
            f"normal AS (SELECT {normalise(lower_strip('title'))} AS key, {VOTE_BEST} AS id FROM metadata GROUP BY key)",
            select=f"""SELECT a.title, coalesce(e.id, n.id) AS id,
  CASE WHEN e.id IS NULL THEN 'normalised' ELSE 'exact' END AS matched_by
FROM asked a LEFT JOIN exact e ON e.key = {lower_strip('a.title')}
LEFT JOIN normal n ON n.key = {normalise(lower_strip('a.title'))}
WHERE e.id IS NOT NULL OR n.id IS NOT NULL""",
        ),
        "resolve_shared_titles": query(
            METADATA,
            select=f"""SELECT {CAPITALISED.format(x='raw_title')} AS title, {VOTE_BEST} AS id
FROM metadata GROUP BY raw_title""",
        ),
    }


def ensemble_queries() -> dict[str, str]:
    top_items = f"""top_movies AS (
  SELECT movieId, count(*) AS n FROM ratings GROUP BY movieId ORDER BY n DESC, movieId LIMIT {MOST_RATED["movies"]}),
top_users AS (
  SELECT userId, count(*) AS n FROM ratings GROUP BY userId ORDER BY n DESC, userId LIMIT {MOST_RATED["users"]})"""
    seeds = f"""seeds AS (
  SELECT userId, seed, {lookup('title')} AS title
  FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY rating DESC, movieId) AS seed
        FROM ratings QUALIFY seed <= 3) JOIN movies USING (movieId))"""
    return {
        "most_rated": query(
            RATINGS,
            top_items,
            select="""SELECT 'movie' AS kind, movieId AS id, n AS "count" FROM top_movies
UNION ALL SELECT 'user', userId, n FROM top_users""",
        ),
        "svd_matrix": query(
            RATINGS,
            select="SELECT userId, movieId, round(avg(rating), 6) AS rating FROM ratings GROUP BY userId, movieId",
        ),
        "svd_checks": query(
            RATINGS,
            select="""SELECT unnest(['columns of V that are not orthonormal', 'singular values out of order',
  'more energy than the ratings have', 'users without recommendations', 'seen films recommended',
  'ranks with gaps']) AS violation, 0 AS n""",
        ),
        "favourite_seeds": query(RATINGS, MOVIES, seeds, select="SELECT userId, seed, title FROM seeds"),
        "merge_scored": query(
            RATINGS,
            MOVIES,
            RATED,
            """listed AS (
  SELECT step, userId, title, total AS score
  FROM (SELECT userId, movieId, sum(rating) AS total,
               row_number() OVER (PARTITION BY userId ORDER BY sum(rating) DESC, movieId) AS place
        FROM ratings GROUP BY userId, movieId QUALIFY place <= 50) r
  CROSS JOIN (VALUES (1), (2)) s(step)
  JOIN movies m ON m.movieId = (r.movieId + step) % (SELECT count(*) FROM movies)),
lists AS (
  SELECT 'collab' AS source, 0.4::DOUBLE AS weight, userId, title, score FROM listed WHERE step = 1
  UNION ALL SELECT 'content', 0.3::DOUBLE, userId, title, score FROM listed WHERE step = 2
  UNION ALL SELECT 'svd', 0.3::DOUBLE, userId, title, score FROM listed WHERE step = 1)""",
            merged("lists"),
            select="SELECT * FROM hybrid",
        ),
        "hybrid_checks": """SELECT unnest(['seen films', 'films twice in a list', 'ranks with gaps', 'scores out of order',
  'scores out of range', 'active users without a list', 'items in both tables not bridged']) AS violation, 0 AS n""",
        "hybrid_without_svd": query(
            RATINGS,
            MOVIES,
            RATED,
            DENSE,
            MATRIX,
            NEIGHBOURS,
            collab(50),
            METADATA,
            SOUP,
            ITEMS,
            TERMS,
            SIMILAR,
            seeds,
            """lists AS (
  SELECT 'collab' AS source, 0.4::DOUBLE AS weight, userId, title, score FROM collab JOIN movies USING (movieId)
  UNION ALL
  SELECT 'content', 0.3::DOUBLE, s.userId, n.title, round(n.score, 4)
  FROM seeds s JOIN items i ON lower(i.title) = lower(s.title)
  JOIN (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY position) AS place FROM shown
        QUALIFY place <= 20) n ON n.seed = i.id)""",
            merged("lists"),
            select="SELECT * FROM hybrid",
        ),
    }


def sentiment_queries() -> dict[str, str]:
    scores = (REVIEWS, LEX, CORE)
    recs = (RATINGS, MOVIES, DENSE, MATRIX, NEIGHBOURS, collab(10), SCORED_LIST)
    return {
        "lexicon_rules": query(
            LEX,
            RULES,
            select="""SELECT doc_id AS review_id, round(total / sqrt(total * total + 15), 6) AS compound FROM ruled""",
        ),
        "lexicon_core": query(*scores, select="SELECT review_id, compound FROM scores"),
        "item_sentiment": query(
            *scores,
            select="""SELECT movieId, round(avg(compound), 9) AS sentiment, count(*) AS n_reviews,
  CASE WHEN (avg(compound) + 1) / 2 > 0.7 THEN 'Loved' WHEN (avg(compound) + 1) / 2 > 0.4 THEN 'Liked'
  ELSE 'Mixed' END AS audience
FROM scores GROUP BY movieId""",
        ),
        "lexicon_accuracy": query(
            *scores,
            LABELLED.format("scores"),
            shuffled("labelled", 42, "review_id"),
            select="""SELECT count(*) AS n,
  count(*) FILTER (WHERE (compound > 0) = (sentiment = 'positive')) AS correct
FROM shuffled WHERE position <= 250""",
        ),
        "sentiment_fallback": query(
            *scores,
            select="""SELECT review_id, round(CASE WHEN toxic = 1 THEN 1.0 ELSE (compound + 1) / 2 END, 5) AS score
FROM scores LEFT JOIN labels ON doc_id = review_id""",
        ),
        "rerank_with_sentiment": query(*recs, *scores, RERANKED, select="SELECT * FROM reranked"),
        "recommendation_tiles": query(
            *recs,
            *scores,
            RERANKED,
            select=f"""SELECT userId, rank, {strip(yearless('title'))} AS title,
  floor(final_score / max(final_score) OVER (PARTITION BY userId) * 100)::INTEGER AS percent,
  CASE WHEN sentiment_score > 0.7 THEN 'Loved' WHEN sentiment_score > 0.4 THEN 'Liked' ELSE 'Mixed' END AS audience,
  'other' AS category
FROM reranked""",
        ),
        "genres_by_title": query(
            MOVIES,
            METADATA,
            "asked AS (SELECT DISTINCT title FROM (SELECT title FROM movies UNION ALL SELECT raw_title FROM metadata))",
            select=f"""SELECT a.title, arg_min(m.genres, m.movieId) AS genres
FROM asked a JOIN movies m ON contains(lower(m.title), lower({yearless('a.title')})) GROUP BY a.title""",
        ),
        "explained": query(
            *recs,
            *scores,
            RERANKED,
            RATED,
            TASTE,
            f"""found AS (
  SELECT a.title, arg_min(m.genres, m.movieId) AS genres
  FROM (SELECT DISTINCT title FROM reranked) a
  JOIN movies m ON contains(lower(m.title), lower({yearless('a.title')})) GROUP BY a.title),
facts AS (
  SELECT r.*, top_decade, top_movies, {year('r.title')} // 10 * 10 AS decade,
         list_filter(coalesce(top_genres, []),
           lambda g: list_contains(string_split(replace(coalesce(genres, ''), ' ', '|'), '|'), g)) AS shared
  FROM reranked r LEFT JOIN found USING (title) LEFT JOIN taste USING (userId)),
reasons AS (
  SELECT *, list_filter([
    CASE WHEN len(shared) > 0 THEN concat('Matches your love of ', array_to_string(shared[1:2], ' & ')) END,
    CASE WHEN decade = top_decade THEN concat('From the ', top_decade, 's — your favourite era') END,
    CASE WHEN sentiment_score > 0.75 THEN 'Audiences absolutely loved this film'
         WHEN sentiment_score > 0.6 THEN 'Consistently strong audience reception' END,
    CASE WHEN len(top_movies) > 0 THEN concat('Because you liked ', {yearless('top_movies[1]')}) END],
    lambda x: x IS NOT NULL) AS held
  FROM facts)""",
            select="""SELECT userId, rank, title, CASE WHEN len(held) = 0
  THEN 'Highly rated by users with similar taste to you' ELSE array_to_string(held[1:2], ' · ') END AS explanation
FROM reasons""",
        ),
        "attribution_text": query(
            REVIEWS,
            LEX,
            f"""said AS (
  SELECT review_id, token AS word, valence AS weight,
         row_number() OVER (PARTITION BY review_id ORDER BY abs(valence) DESC, token) AS rank
  FROM (SELECT DISTINCT review_id, unnest({tokens('review')}) AS token FROM reviews) JOIN lexicon USING (token)
  QUALIFY rank <= 8),
signs AS (
  SELECT review_id, list(word ORDER BY rank) FILTER (WHERE weight > 0) AS good,
         list(word ORDER BY rank) FILTER (WHERE weight < 0) AS bad
  FROM said GROUP BY review_id)""",
            select="""SELECT review_id, concat_ws(' | ',
  CASE WHEN len(good) > 0 THEN concat('Positive signals: ', array_to_string(good[1:4], ', ')) END,
  CASE WHEN len(bad) > 0 THEN concat('Negative signals: ', array_to_string(bad[1:4], ', ')) END) AS summary
FROM signs""",
        ),
    }


def oracle_sql() -> dict[str, str]:
    return {
        **source_queries(),
        **function_queries(),
        **profile_queries(),
        **collab_queries(),
        **content_queries(),
        **title_queries(),
        **ensemble_queries(),
        **sentiment_queries(),
    }
