"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casemill.llm import (
    byte_bpe, jaccard_join, merkle, mixing, packing, ppm, quality_rules, reverse_search, suffix_dedup, token_counts, topk, toxicity, url_filter,
)
from casemill.llm.registry import ORACLE, QUERIES, query, table

__all__ = ["ORACLE", "QUERIES"]

_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
QUALITY_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d
), windows AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2
), named AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM windows
), met AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM named
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM met WHERE n > 1) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words
  FROM w LEFT JOIN covered USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.3
       AND n_dup_lines / n_lines <= 0.4 AND n_stop_words / n_words >= 0.02 AS kept
FROM f
"""


@query("op6_quality_rules", QUALITY_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op1_top_k_search", TOPK_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def _crc_of_id() -> Column:
    return F.crc32(F.col("doc_id").cast("string"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = toxicity.scored(docs, labels, trains=_crc_of_id() % 5 != 0)
    return found.select(
        "doc_id",
        F.coalesce(_crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


MIXING_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), c AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w, 2 * source_size AS cap FROM s
), l AS (
  SELECT *, 1.5e0 * sum(source_size) OVER () AS budget,
         (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM c WINDOW o AS (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, budget, least(CAST(cap AS DOUBLE), w * (SELECT arg_min(level, cap / w) FROM l WHERE cap / w >= level)) AS target
  FROM l
), q AS (
  SELECT d.*, source_size, target, budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT doc_id, size, budget, (cum + e * source_size) / target AS fin, k, coalesce(source, '') AS source, e
  FROM q CROSS JOIN (VALUES (0), (1)) AS x(e) WHERE size > 0
), r AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY fin, k, source, size, e ROWS UNBOUNDED PRECEDING) <= budget AS kept FROM e
), n AS (
  SELECT doc_id, count(*) AS copies FROM r WHERE kept GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken
FROM q LEFT JOIN n USING (doc_id)
"""


@query("op4_mix_sources", MIXING_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query("op5_url_filter")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))


@query("op3_lm_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ppm.scored(docs, trains=_crc_of_id() % 7 != 2)
    return found.select(
        "doc_id", F.coalesce(_crc_of_id() % 7 == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op10_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: The sum of bits is that of CRC-32 over the decimal id, whose characters are ASCII.
MERKLE_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, source, n_chars, text, coalesce('=' || lang, '') AS g,
         xor(4294967295, list_reduce(
           list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
           lambda c, x: list_reduce(range(8), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(c, x)),
           4294967295)) AS crc
  FROM documents
), e AS (
  SELECT doc_id, lang, g, n_chars, crc,
         concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-')) AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM d
), h AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(CAST(m AS VARCHAR)) || ':' || m, '-') || tail) AS seen
  FROM (SELECT *, n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS m FROM e)
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM h
), nodes AS (
  SELECT 0 AS l, g, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT l + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY l, g, n, i // 2
), subroots AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS l, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY l, n, i // 2
), beside AS (
  SELECT x.g, x.i, string_agg(s.h, '' ORDER BY s.l) AS hs
  FROM leaves x JOIN nodes s ON s.g = x.g AND s.n > 1 AND s.i = xor(x.i >> s.l, 1) GROUP BY ALL
), above AS (
  SELECT x.g, string_agg(s.h, '' ORDER BY s.l) AS hs
  FROM subroots x JOIN tops s ON s.n > 1 AND s.i = xor(x.i >> s.l, 1) GROUP BY ALL
), folds AS (
  SELECT 0 AS l, g, i, n, seen AS h FROM leaves
  UNION ALL
  SELECT f.l + 1, f.g, f.i, (f.n + 1) // 2,
         sha256(CASE WHEN (f.i >> f.l) & 1 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)
  FROM folds f LEFT JOIN nodes s ON s.g = f.g AND s.l = f.l AND s.i = xor(f.i >> f.l, 1) WHERE f.n > 1
), raised AS (
  SELECT 0 AS l, f.g, f.i, r.i AS j, r.n, f.h FROM folds f JOIN subroots r USING (g) WHERE f.n = 1
  UNION ALL
  SELECT f.l + 1, f.g, f.i, f.j, (f.n + 1) // 2,
         sha256(CASE WHEN (f.j >> f.l) & 1 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)
  FROM raised f LEFT JOIN tops s ON s.l = f.l AND s.i = xor(f.j >> f.l, 1) WHERE f.n > 1
)
SELECT x.doc_id, x.leaf, r.subroot, t.h AS root, sha256(coalesce(b.hs, '') || coalesce(a.hs, '')) AS proof_sha256,
       f.h AS folded_root, f.h = t.h AS verified
FROM leaves x JOIN subroots r USING (g) JOIN (SELECT h FROM tops WHERE n = 1) t ON true
LEFT JOIN beside b ON b.g = x.g AND b.i = x.i LEFT JOIN above a ON a.g = x.g
JOIN (SELECT * FROM raised WHERE n = 1) f ON f.g = x.g AND f.i = x.i
"""
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@query("op11_merkle_manifest", MERKLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*LEAF_FIELDS)
    found = F.when(_crc_of_id() % 7 == 0, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))
    checked = merkle.manifest(docs, LEAF_FIELDS, "lang", ["doc_id"], {"n_chars": found})
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
REVERSE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents
), i AS (
  SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark
), q AS (
  SELECT DISTINCT item, item_id, unnest(terms) AS term FROM i
), s AS (
  SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0
), p AS (
  SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d
), tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s
), x AS (
  SELECT item, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""


@query("op12_reverse_search", REVERSE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return reverse_search.searched(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


@query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(byte_bpe.encoded(docs, path), path)
