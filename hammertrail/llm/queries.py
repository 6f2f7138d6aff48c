"""The registered queries of the corpus operators, and their expected SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hammertrail.llm import (
    language, licenses, line_dedup, merkle, minhash, mixing, packing, pivot_index, quality, sharding, toxicity, trie, url_filter,
)
from hammertrail.llm.common import crc_of_id, table


def op1_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.links_and_components(table(spark, sf_dir, "embeddings"), 0.93)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_of_id(F.col("doc_id")) % 4 == 2
    found = language.identify(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_of_id(F.col("doc_id")) % 5 == 0
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(table(spark, sf_dir, "documents")).drop("proof")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pivot_dedup, op2_quality_rules, op3_language_id, op4_toxicity, op5_source_mixing, op6_minhash_dedup,
        op7_license_scan, op8_packing, op9_url_filter, op10_line_dedup, op11_merkle_manifest,
        op12_prefix_trie, op13_sharding,
    )
}

ASCII_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"'[^\x20\x09-\x0D]+'"
#: Two tables for crc32: the eight shifts of every byte, and their results as one list.
CRC_TABLE = """bits AS (
  SELECT k, k::BIGINT AS v, 0 AS s FROM range(256) r(k)
  UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, s + 1 FROM bits WHERE s < 8
), crc_table AS (
  SELECT list(v ORDER BY k) AS t FROM bits WHERE s = 8
)"""


def crc_sql(text: str) -> str:
    """crc32 of an ASCII text, where ``t`` is the list of crc_table."""
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda y: ascii(y)::BIGINT)), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    )


def field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"



SQL: dict[str, str] = {
    "op1_pivot_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93
), reach AS (
  SELECT vec_id AS id, vec_id AS to_id FROM embeddings
  UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.to_id
), c AS (
  SELECT id, min(to_id) AS component_id FROM reach GROUP BY id
), n AS (
  SELECT a, count(*) AS n FROM e GROUP BY a
)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m LEFT JOIN c ON c.id = m.vec_id LEFT JOIN n ON n.a = m.vec_id""",
    "op5_source_mixing": f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
         (3 * source_size)::DOUBLE AS cap FROM s
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)
             - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)
), t AS (
  SELECT source, source_size,
         least(cap, (SELECT max(level) FROM l WHERE level * weight <= cap) * weight) AS target FROM l
), p AS (
  SELECT *, floor(8 * log2(size + 1.0::DOUBLE))::INT AS class,
         ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '~')), 1, 8))::BIGINT % 8 AS cell,
         ('0x' || substr(md5('8|' || coalesce(doc_id::VARCHAR, '~')), 1, 8))::BIGINT AS h FROM d
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, cell, size, h, doc_id) AS place FROM p
), x AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.place,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         (('0x' || substr(md5('9|' || coalesce(r.source, '~')), 1, 8))::BIGINT % 4096 + 0.5::DOUBLE) / 4096 AS u
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       ((floor(rate * place + u) - floor(rate * (place - 1) + u)) * size)::BIGINT AS taken FROM x""",
    "op10_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT *, translate(trim(line, {BLANK}), {ASCII_LOWER}) AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), x AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last_id AS gone FROM k LEFT JOIN f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id""",
    "op6_minhash_dedup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {ASCII_LOWER}), {WORDS}) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) >= 2)
  UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2
), e AS (
  SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b
  WHERE 100 * c.common >= 80 * (x.n + y.n - c.common)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  SELECT doc_id AS id, doc_id AS to_id FROM documents
  UNION SELECT r.id, t.b FROM reach r JOIN both_ways t ON t.a = r.to_id
), m AS (
  SELECT id, min(to_id) AS component_id FROM reach GROUP BY id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE {CRC_TABLE}, leaves AS (
  SELECT doc_id, lang, sha256(head || {field_sql("text")}) AS leaf,
         CASE WHEN {crc_sql("doc_id::VARCHAR")} % 3 = 0 THEN sha256(head || {field_sql(f"translate(text, {ASCII_LOWER})")})
         ELSE sha256(head || {field_sql("text")}) END AS tampered
  FROM (SELECT *, {field_sql("doc_id")} || {field_sql("source")} || {field_sql("lang")} || {field_sql("n_chars")} AS head
        FROM documents), crc_table
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves
), low AS (
  SELECT lang, 0 AS level, i, leaf AS h FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM low) WHERE n > 1 GROUP BY lang, level, i // 8
), subroots AS (
  SELECT lang, level AS levels, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM (SELECT *, max(level) OVER (PARTITION BY lang) AS last FROM low) WHERE level = last
), high AS (
  SELECT 0 AS level, tree AS i, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY level, i // 8
), top AS (
  SELECT level AS levels, h AS root FROM high ORDER BY level DESC LIMIT 1
), runs AS (
  SELECT s.tree, level, i // 8 AS run, list(h ORDER BY i) AS hs FROM low JOIN subroots s ON low.lang IS NOT DISTINCT FROM s.lang
  WHERE level < s.levels GROUP BY ALL
  UNION ALL
  SELECT -1, level, i // 8, list(h ORDER BY i) FROM high WHERE level < (SELECT levels FROM top) GROUP BY ALL
), climb AS (
  SELECT s.tree, p.i AS leaf_no, CASE WHEN s.levels = 0 THEN -1 ELSE s.tree END AS inside, 0 AS level,
         CASE WHEN s.levels = 0 THEN s.tree ELSE p.i END AS i, s.levels, p.tampered AS folded, '' AS siblings
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT c.tree, leaf_no, CASE WHEN inside >= 0 AND c.level + 1 = levels THEN -1 ELSE inside END,
         CASE WHEN inside >= 0 AND c.level + 1 = levels THEN 0 ELSE c.level + 1 END,
         CASE WHEN inside >= 0 AND c.level + 1 = levels THEN c.tree ELSE i // 8 END, levels,
         sha256(array_to_string(hs[:i % 8], '') || folded || array_to_string(hs[i % 8 + 2:], '')),
         siblings || array_to_string(hs[:i % 8], '') || array_to_string(hs[i % 8 + 2:], '')
  FROM climb c JOIN runs r ON r.tree = c.inside AND r.level = c.level AND r.run = c.i // 8
), done AS (
  SELECT c.* FROM climb c, top WHERE inside = -1 AND c.level = top.levels
)
SELECT p.doc_id, p.leaf, s.subroot, top.root, sha256(siblings) AS proof_sha256, folded AS folded_root,
       folded = top.root AS verified
FROM done d JOIN subroots s ON s.tree = d.tree
JOIN placed p ON p.lang IS NOT DISTINCT FROM s.lang AND p.i = d.leaf_no, top""",
    "op12_prefix_trie": f"""
WITH RECURSIVE {CRC_TABLE}, turns AS (
  SELECT conv_id, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS sha,
         strlen(coalesce(text, '')) AS bytes, turn FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS pos FROM turns
), convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {crc_sql("conv_id::VARCHAR")} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), rebuilt AS (
  SELECT c.conv_id, p.sha, p.bytes, row_number() OVER (PARTITION BY c.conv_id ORDER BY p.conv_id <> c.base, p.pos) AS depth
  FROM convs c JOIN placed p ON (p.conv_id = c.base AND p.pos <= c.h) OR (p.conv_id = c.conv_id AND p.pos > c.h)
), rows AS (
  SELECT c.conv_id, d.depth, list_aggregate(list(r.sha ORDER BY r.depth), 'string_agg', '') AS path, arg_max(r.bytes, r.depth) AS bytes
  FROM convs c JOIN rebuilt r ON r.conv_id = c.conv_id JOIN rebuilt d ON d.conv_id = c.conv_id AND r.depth <= d.depth GROUP BY 1, 2
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), marked AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM rows
), nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends
  FROM marked GROUP BY depth, path
), kids AS (
  SELECT left(path, length(path) - 64) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.path = n.path
)
SELECT u.conv_id, u.depth, p.conv_id AS parent_conv_id, u.n_convs, u.n_children,
       count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.bytes)::BIGINT AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM full_nodes u JOIN full_nodes v ON starts_with(v.path, u.path)
LEFT JOIN nodes p ON u.depth > 0 AND p.path = left(u.path, length(u.path) - 64)
GROUP BY u.conv_id, u.depth, p.conv_id, u.n_convs, u.n_children, u.ends, u.path""",
}
