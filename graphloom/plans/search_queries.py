"""Search, review and log-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review as V
from ..operators import search as S
from ..operators.tables import endpoints, query_log, read, sql, symbols
from .registry import query

_BM = "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), t AS (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: starts_with(x, 'wort'))) AS f0, len(list_filter(w, lambda x: starts_with(x, 'license'))) AS f1, len(list_filter(w, lambda x: starts_with(x, 'mor'))) AS f2 FROM w), s AS (SELECT count(*) AS n, avg(len) AS al, count(*) FILTER (f0>0) AS d0, count(*) FILTER (f1>0) AS d1, count(*) FILTER (f2>0) AS d2 FROM t)"


def _term(k: int) -> str:
    return f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len / al))"


@query(f"{_BM} SELECT doc_id, round({_term(0)} + {_term(1)} + {_term(2)}, 6) AS score FROM t CROSS JOIN s WHERE f0 + f1 + f2 > 0")
def ft03_bm25(spark, sf_dir):
    return S.bm25(read(spark, sf_dir, "documents"), "doc_id", "text", "wort license mor").select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_BM} SELECT source, least(floor(ln(1 + max({_term(0)} + {_term(1)} + {_term(2)})) * 12 + 0.5), 25)::BIGINT AS boost FROM t CROSS JOIN s JOIN documents USING (doc_id) WHERE f0 + f1 + f2 > 0 GROUP BY source")
def ft04_bm25_boost(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    found = S.bm25(d, "doc_id", "text", "wort license mor").join(d.select("doc_id", "source"), "doc_id")
    return found.groupBy("source").agg(F.least(F.floor(F.log1p(F.max("score")) * 12 + 0.5), F.lit(25)).alias("boost"))


@query(sql("symbols", rest="SELECT fq_name, CASE WHEN lower(name) = 'red' THEN 120 WHEN regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') = 'red' THEN 112 WHEN contains(lower(name), 'red') THEN 98 WHEN contains(lower(fq_name), 'red') THEN 74 ELSE 40 END::BIGINT AS score FROM symbols"))
def ft06_symbol_score(spark, sf_dir):
    s = symbols(spark, sf_dir)
    return s.select("fq_name", S.symbol_score(F.col("name"), F.col("fq_name"), "red").cast("bigint").alias("score"))


@query("WITH h AS (SELECT page_id AS id, contains(lower(url), 'blog')::INT AS h0, contains(lower(url), 'examp')::INT AS h1, contains(lower(url), 'org')::INT AS h2 FROM pages), s AS (SELECT count(*) AS n, sum(h0) AS d0, sum(h1) AS d1, sum(h2) AS d2 FROM h) SELECT id, h0 + h1 + h2 AS hits, round(h0 * (1 + ln(n / greatest(d0, 1))) + h1 * (1 + ln(n / greatest(d1, 1))) + h2 * (1 + ln(n / greatest(d2, 1))), 6) AS score FROM h CROSS JOIN s WHERE h0 + h1 + h2 > 0")
def ft12_keyword_endpoints(spark, sf_dir):
    e = read(spark, sf_dir, "pages").selectExpr("page_id AS id", "url AS path")
    return S.keyword_search(e, "id", "path", "blog examples org").select("id", "hits", F.round("score", 6).alias("score"))


@query("SELECT count(*) AS n_lines, count(*) FILTER (starts_with(x, '+')) AS added, count(*) FILTER (starts_with(x, '-')) AS removed, count(DISTINCT doc_id) AS n_files FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda l, i: CASE i % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END || l)) AS x FROM documents WHERE text IS NOT NULL)")
def ag22_diff_stats(spark, sf_dir):
    lines = F.posexplode(F.split("text", "\n")).alias("k", "l")
    d = read(spark, sf_dir, "documents").select("doc_id", lines)
    mark = F.when((F.col("k") + 1) % 3 == 0, "+").when((F.col("k") + 1) % 3 == 1, "-").otherwise(" ")
    return V.diff_stats(d.select("doc_id", F.concat(mark, "l").alias("line")), "doc_id", "line")


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(password|secret|api[_-]?key|token)\\s*[:=]') THEN 120 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)(select|insert|update|delete)\\s.*\\+') THEN 90 ELSE 0 END + least(30, n_chars // 100) AS score FROM documents""")
def cardm_hunk_risk(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", V.risk_score(F.col("text"), F.floor(F.col("n_chars") / 100)).alias("score"))


@query(sql("log", rest="SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, tool, count(*) AS n, round(sum(duration_ms), 4) AS total_ms FROM log GROUP BY ALL"))
def sm07_hourly_windows(spark, sf_dir):
    g = query_log(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "tool")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration_ms"), 4).alias("total_ms")).select(F.col("w.start").alias("hour"), "tool", "n", "total_ms")
