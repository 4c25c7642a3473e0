"""Ratings, catalogue, metadata and review tables derived from the test tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.session import dealt

# Stop words and a small lexicon that occur in the test texts.
STOP_WORDS = "the of and to in is that it for was on with be as by this are at from".split()
MOST_RATED = {"movies": 500, "users": 2000}  # lengths of two reports
LEXICON = (
    ("worthless", -1.9),
    ("stupid", -2.4),
    ("than", 0.7),
    ("thing", 1.3),
    ("there", -0.9),
    ("thin", -0.4),
    ("then", 1.1),
    ("rest", 1.5),
    ("ring", 0.6),
    ("resting", 1.2),
    ("rent", -0.5),
    ("sting", -1.4),
    ("heating", 0.3),
    ("seres", 0.8),
)


@dataclass(frozen=True)
class Views:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def n_ratings(self) -> int:
        """One for each line; the files know how many that are."""
        return self.table("lineitem").count()

    @cached_property
    def ratings(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        lines = dealt(lines, self.n_ratings, "l_orderkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            F.col("o_custkey").alias("userId"),
            F.col("l_partkey").alias("movieId"),
            (F.ceil(F.col("l_quantity") / 5) / 2).alias("rating"),
        )

    @cached_property
    def movies(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("movieId"),
            F.expr("concat(p_name, ' ', p_partkey, ' (', 1950 + p_size, ')')").alias("title"),
            F.concat_ws("|", "p_type", "p_brand").alias("genres"),
        )

    @cached_property
    def metadata(self) -> DataFrame:
        """Item metadata with keywords, cast and director, as the loaders produce it."""
        votes = self.table("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
        docs = self.table("documents").select("doc_id", "text", "lang")
        parts = self.table("part")
        return (
            parts.join(docs, parts.p_partkey == docs.doc_id, "left")
            .join(votes, parts.p_partkey == votes.l_partkey, "left")
            .select(
                F.col("p_partkey").alias("id"),
                F.expr("concat(p_name, ' ', p_partkey)").alias("title"),
                F.col("p_name").alias("raw_title"),
                F.concat_ws(" ", "p_type", "p_brand").alias("genre_names"),
                F.coalesce("text", F.lit("")).alias("overview"),
                F.expr("concat(1950 + p_size, '-01-01')").alias("release_date"),
                F.lit(None).cast("double").alias("vote_average"),
                F.coalesce("n", F.lit(0)).cast("double").alias("vote_count"),
                F.coalesce("lang", F.lit("en")).alias("original_language"),
                F.expr("concat(replace(p_name, ' ', ''), ' size', p_size)").alias("keyword_names"),
                F.expr("concat('Ann', p_type, ' Bo', p_size % 7, ' Cy')").alias("cast_names"),
                F.expr("concat('Dir', p_partkey % 97)").alias("director_name"),
            )
        )

    @cached_property
    def reviews(self) -> DataFrame:
        """All documents; those without a label have no sentiment."""
        docs = self.table("documents").select("doc_id", "text")
        labels = self.table("labels").select("doc_id", "quality", F.lit("negative").alias("other"))
        return docs.join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("review_id"),
            (F.col("doc_id") % 50).alias("movieId"),
            F.col("text").alias("review"),
            F.when(F.col("quality") == 1, "positive").otherwise(F.col("other")).alias("sentiment"),
        )

    @cached_property
    def labelled(self) -> DataFrame:
        return self.reviews.where(F.col("sentiment").isNotNull())

    # Messier forms of the same rows, for loaders and title matching.

    @cached_property
    def raw_metadata(self) -> DataFrame:
        return self.metadata.select(
            F.expr(
                "CASE WHEN id % 11 = 5 THEN concat(id, '-01') WHEN id % 7 = 3 THEN concat(' ', id, ' ') "
                "ELSE string(id) END"
            ).alias("id"),
            "title",
            F.expr(
                "CASE WHEN id % 13 = 0 THEN 'not a list' ELSE concat('[{''id'': 1, ''name'': ''', "
                "split_part(genre_names, ' ', 1), '''}, {''id'': None, ''name'': \"', "
                "split_part(genre_names, ' ', 2), '\"}]') END"
            ).alias("genres"),
            "overview",
            "release_date",
            F.lit("").alias("vote_average"),
            F.expr("CASE WHEN id % 17 = 0 THEN 'many' ELSE string(vote_count) END").alias("vote_count"),
            "original_language",
        )

    @cached_property
    def raw_keywords(self) -> DataFrame:
        """Keywords of the smaller items; the others have none."""
        return self.table("part").where("p_size <= 35").select(
            F.col("p_partkey").cast("string").alias("id"),
            F.expr(
                "concat('[{''id'': ', p_size, ', ''name'': ''', p_name, '''}, {''name'': ''size ', p_size, '''}]')"
            ).alias("keywords"),
        )

    @cached_property
    def raw_credits(self) -> DataFrame:
        """Credits of all types but one."""
        return self.table("part").where("p_type <> 'MEDIUM'").select(
            F.col("p_partkey").cast("string").alias("id"),
            F.expr(
                "concat('[{''name'': ''Ann ', p_type, '''}, {''name'': ''Bo ', p_size % 7, '''}, "
                "{''name'': ''Cy''}, {''name'': ''Di''}]')"
            ).alias("cast"),
            F.expr(
                "concat('[{', CASE WHEN p_partkey % 5 = 2 THEN '' ELSE '''job'': ''Writer'', ' END, "
                "'''name'': ''W''}, {''job'': ''Director'', ''name'': ''Dir ', p_partkey % 97, '''}]')"
            ).alias("crew"),
        )

    @cached_property
    def odd_titles(self) -> DataFrame:
        """Catalogue titles with articles, accents, stray blanks, or no year."""
        return self.table("part").select(
            F.col("p_partkey").alias("movieId"),
            F.expr(
                """CASE p_partkey % 6
                WHEN 0 THEN concat(initcap(p_name), ', The (', 1950 + p_size, ')')
                WHEN 1 THEN concat(initcap(p_name), ', A Tale (', 1950 + p_size, ') ')
                WHEN 2 THEN concat(' The  ', p_name, '''s: an Élan!')
                WHEN 3 THEN concat(p_name, ' (', 1950 + p_size, ') ', p_partkey)
                WHEN 4 THEN concat(chr(160), upper(p_name), '_a-', p_size, '\t')
                ELSE concat(p_name, ' ', p_partkey, ' (', 1950 + p_size, ')') END"""
            ).alias("title"),
        )

    @cached_property
    def title_queries(self) -> DataFrame:
        """Titles as typed: shouted, with an article and punctuation, or unknown."""
        return self.metadata.select(
            F.expr(
                """CASE id % 3 WHEN 0 THEN concat(' ', upper(title)) WHEN 1 THEN concat('The ', title, '!')
                ELSE concat(title, ' returns') END"""
            ).alias("title")
        )

    @cached_property
    def misspelt(self) -> DataFrame:
        """Titles with a letter left out, words swapped, or buried in a longer text."""
        return self.metadata.select(
            F.expr(
                """CASE id % 4 WHEN 0 THEN concat(substr(title, 1, 2), substr(title, 4))
                WHEN 1 THEN concat(id, ' ', raw_title)
                WHEN 2 THEN concat('somewhere beyond the quiet hills we looked for ', title, ' every single day')
                ELSE title END"""
            ).alias("title")
        )
