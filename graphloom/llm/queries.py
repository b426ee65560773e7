"""Queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, hard_negatives, importance, lm_score, metric_join, minhash, packing, quality_rules, sharding, token_store, toxicity
from .common import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op2_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.scores(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 5) for c in ("log_score", "mean_log_score")})


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2).drop("row", "first")


def op7_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.range_links(table(spark, sf_dir, "embeddings"))


def op9_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def op10_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op11_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_bpe_segment_tree, op3_quality_rules, op4_stupid_backoff, op5_importance_resampling, op6_super_minhash, op7_mil_toxicity, op8_metric_range_join, op9_stratified_shards, op10_bin_completion, op11_voronoi_negatives, op12_wu_manber, op13_divergence_audit)}

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    # counts over all documents, less the scored document's own
    "op4_stupid_backoff": rf"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), tok AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM doc
), seq AS (
  SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM tok
), c1 AS (SELECT w, count(*) AS c FROM tok GROUP BY w
), o1 AS (SELECT doc_id, w, count(*) AS c FROM tok GROUP BY ALL
), c2 AS (SELECT p, w, count(*) AS c FROM seq WHERE p IS NOT NULL GROUP BY ALL
), o2 AS (SELECT doc_id, p, w, count(*) AS c FROM seq WHERE p IS NOT NULL GROUP BY ALL
), lone AS (SELECT doc_id, w, c1.c - o1.c AS c FROM o1 JOIN c1 USING (w)
), ltwo AS (SELECT doc_id, o2.p, o2.w, c2.c - o2.c AS c FROM o2 JOIN c2 USING (p, w)
), n AS (SELECT count(*) AS n FROM tok
), v AS (
  SELECT s.doc_id, s.pos, coalesce(b.c, 0) > 0 AS hit,
    CASE WHEN coalesce(b.c, 0) > 0 THEN b.c / q.c
         WHEN u.c > 0 THEN 0.4 * u.c / greatest(n.n - len(d.ws), 1) ELSE 0.4 * 0.4 / greatest(n.n - len(d.ws), 1) END AS x
  FROM seq s JOIN doc d USING (doc_id) CROSS JOIN n JOIN lone u ON u.doc_id = s.doc_id AND u.w = s.w
  LEFT JOIN ltwo b ON b.doc_id = s.doc_id AND b.p = s.p AND b.w = s.w LEFT JOIN lone q ON q.doc_id = s.doc_id AND q.w = s.p
), a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (NOT hit) AS n_backoff, sum(ln(x)) AS t FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(t, 0.0), 5) AS log_score,
  CASE WHEN n_words > 0 THEN round(t / n_words, 5) END AS mean_log_score
FROM doc d LEFT JOIN a USING (doc_id)""",
    "op11_voronoi_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, v.vec_id, v.label, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS s FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.s AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 30 * positive_score <= 100 * s.s AND 100 * s.s <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.s DESC, s.vec_id) QUALIFY rank <= 10""",
    "op12_wu_manber": rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), cut AS (
  SELECT item, ws, unnest(range(0, greatest(len(ws) - 9, 1))) AS k FROM item WHERE len(ws) > 0
), win AS (SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[k + 1 : k + 10], ' ') AS w FROM cut
), place AS (SELECT r, unnest(range(0, len(ws))) AS k, ws FROM doc
), gram AS (
  SELECT r, k, size, array_to_string(ws[k + 1 : k + size], ' ') AS w FROM place, (SELECT DISTINCT size FROM win) WHERE k + size <= len(ws)
), occ AS (SELECT r, k, gram.size, item FROM gram JOIN win USING (w, size)
), hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS k FROM (SELECT DISTINCT r, k, size FROM occ)) GROUP BY r
), named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
    "op13_divergence_audit": rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_A}', '{_Z}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), tok AS (SELECT r, lang, source, unnest(ws) AS term FROM doc
), kept AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY ALL HAVING count(DISTINCT r) >= 10
), v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), grp AS (SELECT DISTINCT lang, source FROM doc
), own AS (SELECT lang, source, term, count(*) AS c FROM tok GROUP BY ALL
), full_ AS (
  SELECT g.lang, g.source, k.term, CAST(coalesce(o.c, 0) AS HUGEINT) AS c, CAST(k.n AS HUGEINT) AS n
  FROM grp g JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), tot AS (SELECT lang, source, sum(c) AS n FROM full_ GROUP BY ALL
), p AS (
  SELECT f.lang, f.source, f.term, f.c, 1 + (1000000000 * (f.c + 2)) // CAST(tot.n + 2 * v.v AS HUGEINT) AS p, 1 + (1000000000 * (f.n + 2)) // CAST(v.n + 2 * v.v AS HUGEINT) AS q
  FROM full_ f JOIN tot ON tot.lang = f.lang AND tot.source = f.source JOIN v ON v.lang = f.lang
), far AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), al AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(far.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM al
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10""",
}
