"""Code-intelligence tables (files, symbols, calls, dependencies, ...) bound to the driver's tables.

Operators take DataFrames with these columns; only this module knows where a benchmark's rows come from.  ``SQL`` holds
the same bindings as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROLE = "CASE doc_id % 10 WHEN 0 THEN 'test_source' WHEN 1 THEN 'generated' WHEN 2 THEN 'mock_source' WHEN 3 THEN 'build_config' WHEN 4 THEN 'resource_config' ELSE 'main_source' END"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, role, size, blob_hash"""
    return read(spark, sf_dir, "documents").selectExpr("doc_id", "concat(source, '/', lang, '/doc_', doc_id) AS path", "lang AS language", f"{ROLE} AS role", "n_chars AS size", "sha2(text, 256) AS blob_hash")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fq_name, name, kind, file, line, end_line"""
    return read(spark, sf_dir, "part").selectExpr(
        "concat(p_brand, '.', p_name, '.', p_partkey) AS fq_name", "p_name AS name", "CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'method' WHEN 3 THEN 'field' ELSE 'enum' END AS kind",
        "concat('src/', p_partkey % 97, '.java') AS file", "cast(p_size AS bigint) AS line", "cast(p_size + p_partkey % 13 AS bigint) AS end_line", "p_partkey AS id",
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller, callee, file, line, confidence, tier"""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "concat('S', l_suppkey) AS caller", "concat('P', l_partkey) AS callee", "concat('src/', l_orderkey % 97, '.java') AS file", "cast(l_linenumber AS bigint) AS line",
        "round(1 - l_discount * 5, 4) AS confidence", "CASE l_returnflag WHEN 'R' THEN 'low_signal' WHEN 'A' THEN 'primary' ELSE 'provider' END AS tier",
    )


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: a file and one that it depends on (a part and the next one in the same order)."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(order).alias("b"))
    return rows.filter("b IS NOT NULL AND a <> b").distinct()


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, method, path"""
    return read(spark, sf_dir, "pages").selectExpr("page_id AS id", "CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS method", "regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path")


#: Names like those of a Java tree, made of a part's name, brand and number; both engines read these expressions.
_OWNER = "concat(upper(substring(split_part(p_name,' ',1),1,1)), substring(split_part(p_name,' ',1),2), upper(substring(split_part(p_name,' ',2),1,1)), substring(split_part(p_name,' ',2),2), CASE p_partkey % 7 WHEN 0 THEN 'Service' WHEN 1 THEN 'Validator' WHEN 2 THEN 'Cache' WHEN 3 THEN 'Application' WHEN 4 THEN 'Listener' WHEN 5 THEN 'Repository' ELSE '' END)"
_MEMBER = "CASE WHEN p_partkey % 11 = 0 THEN 'main' ELSE concat('handle', upper(substring(split_part(p_name,' ',2),1,1)), substring(split_part(p_name,' ',2),2)) END"
_KIND = "CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'method' WHEN 3 THEN 'field' ELSE 'enum' END"
_PACKAGE = "lower(replace(p_brand, '#', ''))"
_TOP = "p_partkey % 5 NOT IN (2, 3)"
_FILE = f"concat({_PACKAGE}, '/', {_OWNER}, '.java')"
_FILE_ROLE = "CASE length({}) % 10 WHEN 0 THEN 'test_source' WHEN 1 THEN 'generated' WHEN 2 THEN 'mock_source' WHEN 3 THEN 'build_config' WHEN 4 THEN 'resource_config' ELSE 'main_source' END"
_RICH = (
    f"p_partkey AS id, concat({_PACKAGE}, '.', {_OWNER}, CASE WHEN {_TOP} THEN '' ELSE concat('.', {_MEMBER}) END) AS fq_name, CASE WHEN {_TOP} THEN {_OWNER} ELSE {_MEMBER} END AS name, {_KIND} AS kind, {_FILE} AS file, cast(p_size AS bigint) AS line, "
    f"{_PACKAGE} AS package, {_FILE_ROLE.format(_FILE)} AS role, CASE p_size % 6 WHEN 0 THEN 'spring:service' WHEN 1 THEN 'spring:security' WHEN 2 THEN 'spring:cacheable' WHEN 3 THEN 'spring:repository' END AS framework_role, concat('public ', p_type, ' ', p_name) AS signature, "
    "CASE WHEN p_size % 9 = 0 THEN lower(replace(p_name, ' ', '_')) ELSE '' END AS db_name, p_partkey % 17 = 0 AS synthetic"
)


def search_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, fq_name, name, kind, file, line, package, role, framework_role, signature, db_name, synthetic, annotations, in_degree"""
    s = read(spark, sf_dir, "part").selectExpr(*split_columns(_RICH), "CASE p_size % 5 WHEN 0 THEN array('Transactional') WHEN 1 THEN array('Cacheable', 'Valid') ELSE cast(array() AS array<string>) END AS annotations")
    n = calls(spark, sf_dir).filter("tier IN ('primary', 'provider')").groupBy(F.expr("cast(substring(callee, 2) AS bigint)").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return s.join(n, "id", "left")


def split_columns(columns: str) -> list[str]:
    """The expressions of a select list: cut at commas outside brackets and quotes."""
    out, depth, quoted = [""], 0, False
    for c in columns:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return out


def search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, role, degree, bm25: the files of ``search_symbols``"""
    s = search_symbols(spark, sf_dir).select("id", "file", "role")
    d = dependencies(spark, sf_dir).select(F.explode(F.array("a", "b")).alias("id")).join(s.select("id", "file"), "id").groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("degree"))
    return s.groupBy(F.col("file").alias("path")).agg(F.lit("java").alias("language"), F.max("role").alias("role"), F.lit(None).cast("bigint").alias("bm25")).join(d, "path", "left").select("path", "language", "role", "degree", "bm25")


def file_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, method, path: endpoints and the files of ``search_symbols`` that handle them"""
    s = search_symbols(spark, sf_dir).select("id", "file")
    return endpoints(spark, sf_dir).join(s, "id").select("file", "method", "path")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, tool, session, duration_ms, args"""
    return read(spark, sf_dir, "events").selectExpr("event_id AS id", "ts", "event_type AS tool", "user_id AS session", "value AS duration_ms", "props AS args")


#: The same tables as DuckDB expressions; ``sql("files", "calls", ...)`` makes a WITH clause of them.
_SQL = {
    "files": f"SELECT doc_id, source||'/'||lang||'/doc_'||doc_id AS path, lang AS language, {ROLE} AS role, n_chars AS size, sha256(text) AS blob_hash FROM documents",
    "symbols": "SELECT p_brand||'.'||p_name||'.'||p_partkey AS fq_name, p_name AS name, CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'method' WHEN 3 THEN 'field' ELSE 'enum' END AS kind, 'src/'||(p_partkey % 97)||'.java' AS file, p_size::BIGINT AS line, (p_size + p_partkey % 13)::BIGINT AS end_line, p_partkey AS id FROM part",
    "calls": "SELECT 'S'||l_suppkey AS caller, 'P'||l_partkey AS callee, 'src/'||(l_orderkey % 97)||'.java' AS file, l_linenumber::BIGINT AS line, round(1 - l_discount * 5, 4) AS confidence, CASE l_returnflag WHEN 'R' THEN 'low_signal' WHEN 'A' THEN 'primary' ELSE 'provider' END AS tier FROM lineitem",
    "deps": "SELECT DISTINCT a, b FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS b FROM lineitem) WHERE b IS NOT NULL AND a <> b",
    "found_symbols": f"SELECT {_RICH}, CASE p_size % 5 WHEN 0 THEN ['Transactional'] WHEN 1 THEN ['Cacheable', 'Valid'] ELSE []::VARCHAR[] END AS annotations, n.in_degree FROM part LEFT JOIN (SELECT l_partkey AS k, count(*) AS in_degree FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) n ON n.k = p_partkey",
    "found_files": "SELECT s.path, 'java' AS language, s.role, d.degree, NULL::BIGINT AS bm25 FROM (SELECT file AS path, max(role) AS role FROM found_symbols GROUP BY 1) s LEFT JOIN (SELECT file AS path, count(*) AS degree FROM (SELECT a AS id FROM deps UNION ALL SELECT b FROM deps) JOIN found_symbols USING (id) GROUP BY 1) d USING (path)",
    "found_endpoints": "SELECT s.file, e.method, e.path FROM endpoints e JOIN found_symbols s USING (id)",
    "endpoints": "SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS method, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages",
    "log": "SELECT event_id AS id, ts, event_type AS tool, user_id AS session, value AS duration_ms, props AS args FROM events",
}


def sql(*names: str, rest: str) -> str:
    recursive = "RECURSIVE " if rest.lstrip().startswith("--recursive") else ""
    rest = rest.replace("--recursive", "").lstrip()
    head = ", ".join(f"{n} AS ({_SQL[n]})" for n in names)
    return f"WITH {recursive}{head}" + (f", {rest[5:]}" if rest.startswith("WITH ") else f" {rest}")
