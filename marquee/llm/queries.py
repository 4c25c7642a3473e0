"""Registered queries of this subpackage, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import bpe, chat, covers, merkle, minhash, packing, quality, runs, shards, subspace, suffix, tokencount, warc
from marquee.llm.shared import table
from marquee.session import shared_folder


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path)


def op2_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.linked_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judge(docs).select(
        "doc_id", *[F.col("quality")[n].alias(n) for n in names], "verdict.base_failed", "verdict.kept"
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    talks = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    formatted = chat.format_turns(talks.unionByName(probe), vocabulary, public_tokenizers.PATTERN)
    return chat.read_back(formatted, vocabulary)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.cut_report(table(spark, sf_dir, "documents"))
    return found.withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return minhash.near_duplicates(docs).select("doc_id", "class_id", "class_size", "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


def op11_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covers.cut_passages(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.sha2("kept_text", 256), F.col("words_sha256")).alias("kept_sha256")
    return found.select("doc_id", "n_words", "n_removed", kept)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the texts is made periodic from some word on, by the CRC-32 of the doc_id (none without one)."""
    words = F.filter(F.split("text", "[\\x09-\\x0D ]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    tail = F.col("n") - F.col("a")
    repeated = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(tail / F.col("p")).cast("int")))
    changed = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a")), F.slice(repeated, F.lit(1), tail))
    docs = (
        table(spark, sf_dir, "documents")
        .select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
        .withColumn("n", F.size("words"))
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
        .withColumn("p", (1 + F.floor(tail / (3 + F.col("g") % 8))).cast("int"))
    )
    return runs.run_report(runs.find_runs(docs.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without_breaks = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verified_manifest(docs.withColumn("seen_text", without_breaks))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_warc,
            op2_subspace_join,
            op3_quality_rules,
            op4_chat_format,
            op5_suffix_dedup,
            op6_byte_bpe,
            op7_extendible_shards,
            op8_best_fit_packing,
            op9_weighted_minhash,
            op10_token_counts,
            op11_cover_anchors,
            op12_periodic_runs,
            op13_merkle,
        )
    }


WARC_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT d, min(page_id) AS first FROM p WHERE n >= 100 AND page_id IS NOT NULL GROUP BY d
)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

VECTORS_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {subspace.THRESHOLD}
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.m, vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""


def _rules_sql(rules: tuple[quality.Rule, ...]) -> str:
    tests = [f"{r.metric} >= {r.low}" for r in rules if r.low is not None]
    return " AND ".join(tests + [f"{r.metric} <= {r.high}" for r in rules if r.high is not None])


_GAPS = r"[ \t\n\x0B\f\r]+"
_SHARE = "coalesce({0} / nullif({1}, 0)::DOUBLE, 0)"

QUALITY_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{_GAPS}'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_GAPS}', '', 'g') <> '') AS lines
  FROM d
), g AS (
  SELECT r, i, array_to_string(words[i : i + 7], ' ') AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1
), again AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM twice, range(8) AS x(k)) GROUP BY r
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{_GAPS}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(words, lambda x: list_contains({[w.lower() for w in quality.STOP_WORDS]}, lower(x)))) AS n_stop
  FROM w LEFT JOIN again USING (r)
), q AS (
  SELECT *, {_SHARE.format("word_chars", "n_words")} AS mean_word_chars,
         {_SHARE.format("n_symbols", "word_chars")} AS symbol_ratio, {_SHARE.format("n_stop", "n_words")} AS stop_ratio,
         {_SHARE.format("n_dup_lines", "n_lines")} AS dup_line_ratio,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_rules_sql(quality.RULES)} AS kept
FROM q
"""

_ESCAPED = r"""regexp_replace(regexp_replace({0}, '(\\*)(<s>|\[INST\]|\[/INST\]|</s>)', '\1\1\\\2', 'g'), '(\\+)\z', '\1\1')"""

CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, sha256(role), sha256(text))) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, sha256(role), sha256(text)) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       (3 + sum(17 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

SHARDS_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS n,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 16))::UBIGINT),
              64, '0') AS bits
  FROM documents
), p AS (
  SELECT r, doc_id, n, k AS depth, substr(bits, 1, k) AS shard FROM d, range(0, 65) AS x(k)
), s AS (
  SELECT depth, shard, count(*) AS shard_docs, sum(n) AS shard_bytes FROM p GROUP BY depth, shard
)
SELECT doc_id, n::BIGINT AS n_bytes, shard, depth::INT AS depth, shard_docs::BIGINT AS shard_docs,
       shard_bytes::BIGINT AS shard_bytes
FROM p JOIN s USING (depth, shard) WHERE shard_bytes <= {shards.LIMIT} OR shard_docs = 1
QUALIFY row_number() OVER (PARTITION BY r ORDER BY depth) = 1
"""

COVERS_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_GAPS}'), lambda x: x <> '') AS words
  FROM documents
), g AS MATERIALIZED (
  SELECT r, doc_id, i, md5(array_to_string(words[i : i + {covers.LENGTH - 1}], ' ')) AS gram
  FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - {covers.LENGTH - 2})) AS i FROM d)
), gone AS (
  SELECT DISTINCT r, i + k AS p
  FROM (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS low FROM g) WHERE doc_id > low),
       range({covers.LENGTH}) AS x(k)
), w AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d
), k AS (
  SELECT w.r, string_agg(word, ' ' ORDER BY w.p) FILTER (gone.p IS NULL) AS kept, count(gone.p) AS n_removed
  FROM w LEFT JOIN gone ON gone.r = w.r AND gone.p = w.p GROUP BY w.r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

#: Levels that the SQL has: enough for 3 ** 13 leaves of a source.
_MERKLE_LEVELS = 13

#: The CRC-32 of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''),
  lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
  lambda a, z: xor(a >> 1, (a & 1) * 3988292384))))"""


def _merkle_field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _merkle_tree(name: str, levels: int) -> str:
    """CTEs of a tree over ``{name}0(tree, idx, n, d)``: levels ``{name}k`` and steps ``{name}_step_k``."""
    out = []
    for k in range(levels):
        out.append(f"""
{name}_step{k} AS MATERIALIZED (
  SELECT a.tree, a.idx, a.n, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL
), {name}{k + 1} AS MATERIALIZED (
  SELECT tree, idx // 3 AS idx, (n + 2) // 3 AS n, sha256(string_agg(d, '' ORDER BY idx)) AS d
  FROM {name}{k} WHERE n > 1 GROUP BY tree, idx // 3, n
  UNION ALL SELECT tree, idx, n, d FROM {name}{k} WHERE n = 1
)""")
    return ",".join(out)


def _merkle_walk(source: str, tree: str, key: str, place: str, levels: int) -> str:
    """``source`` with proof, folded digest and place led through the levels of a tree."""
    sql = source
    for k in range(levels):
        sql = f"""
SELECT w.* REPLACE (w.proof || coalesce(s.l || s.r, '') AS proof, CASE WHEN s.l IS NULL THEN w.fold
  ELSE sha256(s.l || w.fold || s.r) END AS fold, CASE WHEN s.l IS NULL THEN w.{place} ELSE w.{place} // 3 END AS {place})
FROM ({sql}) w LEFT JOIN {tree}_step{k} s ON s.tree = w.{key} AND s.idx = w.{place}"""
    return sql


_SEEN_TEXT = f"CASE WHEN {_CRC.format('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
_MERKLE_LEAF = "sha256(" + " || ".join(_merkle_field(f) for f in merkle.FIELDS) + ")"

MERKLE_SQL = f"""
WITH x AS MATERIALIZED (
  SELECT doc_id, source, lang, n_chars, text, {_SEEN_TEXT} AS seen FROM documents
), d AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_MERKLE_LEAF} AS leaf,
         {_MERKLE_LEAF.replace("text", "seen")} AS seen FROM x
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY tree) AS n FROM d
), t0 AS (SELECT tree, idx, n, leaf AS d FROM leaves),
{_merkle_tree("t", _MERKLE_LEVELS)},
tops AS MATERIALIZED (
  SELECT tree AS source_key, d, row_number() OVER (ORDER BY encode(tree)) - 1 AS top, count(*) OVER () AS n
  FROM t{_MERKLE_LEVELS}
), r0 AS (SELECT '' AS tree, top AS idx, n, d FROM tops),
{_merkle_tree("r", _MERKLE_LEVELS)},
walked AS (
  SELECT w.*, tops.top, tops.d AS subroot, '' AS everything
  FROM ({_merkle_walk("SELECT *, '' AS proof, seen AS fold FROM leaves", "t", "tree", "idx", _MERKLE_LEVELS)}) w
  JOIN tops ON tops.source_key = w.tree
), ended AS (
  SELECT * FROM ({_merkle_walk("SELECT * FROM walked", "r", "everything", "top", _MERKLE_LEVELS)})
)
SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.d AS verified
FROM ended, r{_MERKLE_LEVELS} r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": WARC_SQL,
        "op2_subspace_join": VECTORS_SQL,
        "op3_quality_rules": QUALITY_SQL,
        "op4_chat_format": CHAT_SQL,
        "op7_extendible_shards": SHARDS_SQL,
        "op11_cover_anchors": COVERS_SQL,
        "op13_merkle": MERKLE_SQL,
    }
