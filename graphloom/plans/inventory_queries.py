"""Queries of the remaining relational, graph, search and impact operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import impact as I
from ..operators import relational as R
from ..operators.tables import calls, dependencies, endpoints, files, query_log, read, sql, symbols
from .registry import query

ONE = "*"  # what a count counts


@query(sql("symbols", rest="SELECT fq_name, kind FROM symbols WHERE kind IN ('class','interface','enum','type')"))
def flt05_class_kinds(spark, sf_dir):
    return symbols(spark, sf_dir).filter(R.kind_is("class")).select("fq_name", "kind")


@query(sql("symbols", "calls", rest="SELECT callee, count(*) AS n, max(confidence) AS best FROM calls c WHERE tier <> 'low_signal' AND NOT EXISTS (SELECT 1 FROM symbols s WHERE 'P'||(s.id * 2) = c.callee) GROUP BY callee ORDER BY n DESC, callee LIMIT 20"))
def ag04_unresolved_calls(spark, sf_dir):
    known = symbols(spark, sf_dir).select(F.concat(F.lit("P"), F.col("id") * 2).alias("callee"))
    n = R.visible_calls(calls(spark, sf_dir)).groupBy("callee").agg(F.count(ONE).alias("n"), F.max("confidence").alias("best"))
    return n.join(known, "callee", "left_anti").orderBy(F.desc("n"), "callee").limit(20)


@query(sql("symbols", "calls", rest="""SELECT file, coalesce(s.n_symbols, 0) AS n_symbols, s.names, coalesce(c.n_calls, 0) AS n_calls, coalesce(c.n_callees, 0) AS n_callees
 FROM (SELECT file, count(*) AS n_symbols, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM symbols GROUP BY file) s FULL JOIN (SELECT file, count(*) AS n_calls, count(DISTINCT callee) AS n_callees FROM calls GROUP BY file) c USING (file)"""))
def ag07_file_evidence(spark, sf_dir):
    s = symbols(spark, sf_dir).groupBy("file").agg(F.count(ONE).alias("n_symbols"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))
    c = calls(spark, sf_dir).groupBy("file").agg(F.count(ONE).alias("n_calls"), F.countDistinct("callee").alias("n_callees"))
    return s.join(c, "file", "full").fillna(0)


@query("SELECT l_linestatus AS access, l_returnflag AS kind, 'src/'||(l_orderkey % 97)||'.java' AS owner, count(*) AS n, count(DISTINCT l_partkey) AS n_fields FROM lineitem GROUP BY ALL")
def ag11_usage_groups(spark, sf_dir):
    u = read(spark, sf_dir, "lineitem").selectExpr("l_linestatus AS access", "l_returnflag AS kind", "concat('src/', l_orderkey % 97, '.java') AS owner", "l_partkey")
    return u.groupBy("access", "kind", "owner").agg(F.count(ONE).alias("n"), F.countDistinct("l_partkey").alias("n_fields"))


@query(sql("calls", rest="SELECT file, count(*) AS n, min(line) AS first_line FROM calls GROUP BY file ORDER BY n DESC, first_line, file LIMIT 50"))
def ag12_rank_files(spark, sf_dir):
    return calls(spark, sf_dir).groupBy("file").agg(F.count(ONE).alias("n"), F.min("line").alias("first_line")).orderBy(F.desc("n"), "first_line", "file").limit(50)


@query(sql("calls", rest="""SELECT e.caller, e.callee, e.edge_count, e.confidence, x.evidence FROM (SELECT caller, callee, count(*) AS edge_count, max(confidence) AS confidence FROM calls GROUP BY ALL) e
 JOIN (SELECT caller, callee, string_agg(place, ' ' ORDER BY place) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY caller, callee ORDER BY place) AS rn FROM (SELECT DISTINCT caller, callee, file||':'||line AS place FROM calls)) WHERE rn <= 8 GROUP BY ALL) x USING (caller, callee)"""))
def ag14_merged_edges(spark, sf_dir):
    rows = calls(spark, sf_dir).select("caller", "callee", "confidence", F.concat_ws(":", "file", "line").alias("place"))
    return R.merged_edges(rows, ["caller", "callee"], "confidence", "place", 8)


@query(sql("deps", rest="SELECT a % 20 AS from_module, b % 20 AS to_module, count(*) AS edge_count FROM deps WHERE a % 20 <> b % 20 GROUP BY ALL"))
def ag17_module_dependencies(spark, sf_dir):
    d = dependencies(spark, sf_dir).selectExpr("a % 20 AS from_module", "b % 20 AS to_module")
    return d.filter("from_module <> to_module").groupBy("from_module", "to_module").agg(F.count(ONE).alias("edge_count"))


@query(sql("files", rest="SELECT split_part(path,'/',1) AS directory, count(*) AS n_files, sum(size)::BIGINT AS bytes, count(DISTINCT language) AS n_languages, count(*) FILTER (role = 'test_source') AS n_tests FROM files GROUP BY 1"))
def ag21_directory_stats(spark, sf_dir):
    f = files(spark, sf_dir).groupBy(F.substring_index("path", "/", 1).alias("directory"))
    return f.agg(F.count(ONE).alias("n_files"), F.sum("size").alias("bytes"), F.countDistinct("language").alias("n_languages"), F.count_if(F.col("role") == "test_source").alias("n_tests"))


@query(sql("symbols", rest="SELECT name, fq_name, kind FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'interface' THEN 1 WHEN 'method' THEN 2 ELSE 3 END, line, fq_name) AS rn FROM symbols) WHERE rn = 1"))
def wn01_first_by_priority(spark, sf_dir):
    return R.top_per_key(symbols(spark, sf_dir), ["name"], [R.rank_of("kind", ("class", "interface", "method")), F.col("line"), F.col("fq_name")], 1).select("name", "fq_name", "kind")


@query(sql("symbols", rest="""WITH r AS (SELECT name, fq_name, kind, line, row_number() OVER (PARTITION BY name, kind ORDER BY line DESC, fq_name) AS k FROM symbols),
 o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN k <= 2 THEN 0 ELSE 1 END, line DESC, fq_name) AS place FROM r) SELECT name, fq_name, kind, place FROM o WHERE place <= 12"""))
def wn05_reserved_slots(spark, sf_dir):
    return R.reserved_slots(symbols(spark, sf_dir), "name", "kind", [F.desc("line"), F.col("fq_name")], 2, 12).select("name", "fq_name", "kind", "place")


@query("""SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn FROM documents)
 WHERE used <= 20000 AND rn <= 5""")
def wn06_running_budget(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return R.within_budget(d, ["source"], [F.col("n_chars"), F.col("doc_id")], "n_chars", 20000, 5).select("source", "doc_id", "used")


@query(sql("symbols", rest="""SELECT fq_name, origin FROM (SELECT *, row_number() OVER (PARTITION BY fq_name ORDER BY p) AS rn FROM (SELECT fq_name, 'exact' AS origin, 0 AS p FROM symbols WHERE name LIKE 'a%'
 UNION ALL SELECT fq_name, 'broad', 1 FROM symbols WHERE contains(lower(fq_name), 'brand#1') UNION ALL SELECT fq_name, 'concept', 2 FROM symbols WHERE kind = 'class')) WHERE rn = 1"""))
def st02_priority_union(spark, sf_dir):
    s = symbols(spark, sf_dir)
    parts = {"exact": s.filter("name LIKE 'a%'"), "broad": s.filter(R.contains_text("fq_name", "brand#1")), "concept": s.filter("kind = 'class'")}
    return R.priority_union({k: v.select("fq_name") for k, v in parts.items()}, ["fq_name"])


@query(sql("calls", rest="SELECT DISTINCT caller, callee FROM calls WHERE tier = 'primary' EXCEPT SELECT caller, callee FROM calls WHERE tier = 'provider'"))
def st03_difference(spark, sf_dir):
    c = calls(spark, sf_dir)
    return c.filter("tier = 'primary'").select("caller", "callee").distinct().join(c.filter("tier = 'provider'").select("caller", "callee"), ["caller", "callee"], "left_anti")


@query(sql("symbols", "deps", rest="SELECT d.a, d.b, x.fq_name AS from_name, y.fq_name AS to_name FROM deps d LEFT JOIN symbols x ON x.id = d.a LEFT JOIN symbols y ON y.id = d.b"))
def jn06_edge_labels(spark, sf_dir):
    s, d = symbols(spark, sf_dir).select("id", "fq_name"), dependencies(spark, sf_dir)
    return d.join(s.toDF("a", "from_name"), "a", "left").join(s.toDF("b", "to_name"), "b", "left").select("a", "b", "from_name", "to_name")


@query(sql("symbols", "calls", rest="SELECT caller, callee, best, min_by(file, (file, line, fq_name)) AS declared_in FROM (SELECT caller, callee, max(confidence) AS best FROM calls GROUP BY ALL) JOIN (SELECT 'P'||(id % 500) AS callee, file, line, fq_name FROM symbols) USING (callee) GROUP BY ALL"))
def jn12_first_declaration(spark, sf_dir):
    first = symbols(spark, sf_dir).groupBy(F.concat(F.lit("P"), F.col("id") % 500).alias("callee")).agg(F.min(F.struct("file", "line", "fq_name")).alias("m"))
    c = calls(spark, sf_dir).groupBy("caller", "callee").agg(F.max("confidence").alias("best"))
    return c.join(first, "callee").select("caller", "callee", "best", F.col("m.file").alias("declared_in"))


@query(sql("symbols", "calls", rest="SELECT id, fq_name FROM symbols s WHERE kind = 'field' AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.tier = 'primary' AND c.line = 7 AND c.callee = 'P'||s.id)"))
def jn17_not_called(spark, sf_dir):
    called = calls(spark, sf_dir).filter("tier = 'primary' AND line = 7").select(F.expr("cast(substring(callee, 2) AS bigint)").alias("id"))
    return symbols(spark, sf_dir).filter("kind = 'field'").join(called, "id", "left_anti").select("id", "fq_name")


@query(sql("symbols", "calls", rest="""SELECT c.caller, c.callee, min(s.fq_name) AS node FROM (SELECT DISTINCT caller, callee FROM calls) c JOIN (SELECT fq_name, unnest([fq_name, name, 'P'||id]) AS alias FROM symbols) s ON s.alias = c.callee GROUP BY ALL"""))
def jn22_alias_nodes(spark, sf_dir):
    alias = symbols(spark, sf_dir).select("fq_name", F.explode(F.array("fq_name", "name", F.concat(F.lit("P"), "id"))).alias("callee"))
    first = alias.groupBy("callee").agg(F.min("fq_name").alias("node"))
    return calls(spark, sf_dir).select("caller", "callee").distinct().join(first, "callee")


@query(sql("symbols", "calls", rest="""SELECT s.fq_name, count(c.caller) AS n_calls, count(DISTINCT c.caller) AS n_callers, count(DISTINCT c.file) AS n_files, count(*) FILTER (c.tier = 'provider') AS n_provider FROM symbols s LEFT JOIN calls c ON c.callee = 'P'||s.id GROUP BY s.fq_name"""))
def gr06_symbol_impact(spark, sf_dir):
    return I.symbol_impact(symbols(spark, sf_dir).select("fq_name", F.concat(F.lit("P"), "id").alias("callee")), calls(spark, sf_dir))


@query(sql("endpoints", "calls", rest="SELECT id, method, path FROM endpoints WHERE 'src/'||(id % 97)||'.java' IN (SELECT file FROM calls WHERE tier = 'provider' AND callee LIKE 'P1%')"))
def gr07_impacted_endpoints(spark, sf_dir):
    hit = calls(spark, sf_dir).filter("tier = 'provider' AND callee LIKE 'P1%'").select("file")
    return endpoints(spark, sf_dir).withColumn("file", F.expr("concat('src/', id % 97, '.java')")).join(hit, "file", "left_semi").select("id", "method", "path")


@query(sql("files", rest="""SELECT path, CASE WHEN doc_id % 13 = 0 THEN 'deleted' WHEN role IN ('build_config','resource_config') THEN 'configuration' WHEN language IS NULL THEN 'unknown' WHEN role = 'test_source' THEN 'changed_test' WHEN path LIKE '%/es/%' THEN 'ignorable' ELSE 'select' END AS decision FROM files"""))
def gr10_ci_selection(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("status", F.when(F.col("doc_id") % 13 == 0, "D").otherwise("M"))
    return f.select("path", I.ci_decision("path", "role", "language", "status", ignorable="/es/").alias("decision"))


@query(sql("deps", "symbols", rest="""SELECT s.id, s.fq_name, x.coverage, coalesce(d.n, 0) AS in_degree FROM symbols s JOIN (SELECT id, count(DISTINCT w) AS coverage FROM (SELECT id, unnest(string_split(lower(name), ' ')) AS w FROM symbols) WHERE w IN ('small','red','steel','large','blue','almond','green') GROUP BY id HAVING count(DISTINCT w) >= 1) x USING (id)
 LEFT JOIN (SELECT b AS id, count(*) AS n FROM deps GROUP BY b) d USING (id)"""))
def gr12_central_files(spark, sf_dir):
    s = symbols(spark, sf_dir).withColumn("coverage", F.size(F.array_intersect(F.split(F.lower("name"), " "), F.array(*map(F.lit, ("small", "red", "steel", "large", "blue", "almond", "green"))))).cast("long"))
    d = dependencies(spark, sf_dir).groupBy(F.col("b").alias("id")).agg(F.count(ONE).alias("in_degree"))
    return s.filter("coverage >= 1").join(d, "id", "left").fillna(0, ["in_degree"]).select("id", "fq_name", "coverage", "in_degree")


@query(sql("files", rest="""SELECT root, max(marked) AS marked, count(*) AS n_files FROM (SELECT path, split_part(path,'/',1)||'/'||split_part(path,'/',2) AS root, (role = 'build_config')::INT AS marked FROM files) GROUP BY root"""))
def gr14_module_roots(spark, sf_dir):
    f = files(spark, sf_dir).select(F.substring_index("path", "/", 2).alias("root"), (F.col("role") == "build_config").cast("int").alias("marked"))
    return f.groupBy("root").agg(F.max("marked").alias("marked"), F.count(ONE).alias("n_files"))


@query(sql("symbols", "calls", "endpoints", rest="""SELECT * FROM (SELECT 'defines' AS type, file AS source, fq_name AS target, count(*) AS edge_count FROM symbols GROUP BY ALL UNION ALL SELECT 'contains', split_part(file,'/',1), file, count(*) FROM symbols GROUP BY ALL
 UNION ALL SELECT 'calls', file, callee, count(*) FROM calls WHERE tier <> 'low_signal' GROUP BY ALL UNION ALL SELECT 'handles', method||' '||path, 'src/'||(id % 97)||'.java', count(*) FROM endpoints GROUP BY ALL)"""))
def gr15_overlay(spark, sf_dir):
    s, e = symbols(spark, sf_dir), endpoints(spark, sf_dir)
    return I.overlay(s.select("file", "fq_name"), R.visible_calls(calls(spark, sf_dir)).select("file", "callee"), e.selectExpr("concat(method, ' ', path) AS endpoint", "concat('src/', id % 97, '.java') AS file"))


@query(sql("deps", rest="WITH s AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS service FROM part) SELECT x.service AS from_service, y.service AS to_service, count(*) AS n, count(DISTINCT d.a) AS files FROM deps d JOIN s x ON x.path = d.a JOIN s y ON y.path = d.b WHERE x.service <> y.service GROUP BY ALL"))
def gr18_cross_service(spark, sf_dir):
    services = read(spark, sf_dir, "part").selectExpr("p_partkey AS path", "CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS service")
    return I.cross_service(dependencies(spark, sf_dir), services)


@query(sql("calls", rest="SELECT caller, callee, file, line, tier, CASE tier WHEN 'low_signal' THEN least(confidence, 0.25) WHEN 'provider' THEN greatest(confidence, 0.9) ELSE confidence END AS capped FROM calls"))
def gr22_edge_confidence(spark, sf_dir):
    return calls(spark, sf_dir).select("caller", "callee", "file", "line", "tier", I.tier_confidence("tier", "confidence").alias("capped"))


@query(sql("symbols", "files", rest="SELECT 'file' AS kind, path AS key, concat_ws(' ', path, split_part(path,'/',3), language, role) AS content FROM files UNION ALL SELECT 'symbol', fq_name, concat_ws(' ', fq_name, name, file, kind) FROM symbols"))
def ft01_search_documents(spark, sf_dir):
    f = files(spark, sf_dir).select(F.lit("file").alias("kind"), F.col("path").alias("key"), F.concat_ws(" ", "path", F.substring_index("path", "/", -1), "language", "role").alias("content"))
    return f.union(symbols(spark, sf_dir).select(F.lit("symbol"), "fq_name", F.concat_ws(" ", "fq_name", "name", "file", "kind")))


@query(sql("symbols", "calls", "files", rest="""SELECT file, sum(score)::BIGINT AS score FROM (SELECT file, 4 * count(*) AS score FROM symbols WHERE contains(file, '1') GROUP BY file UNION ALL SELECT file, 3 * count(*) FROM symbols WHERE contains(lower(fq_name), 'steel') GROUP BY file
 UNION ALL SELECT file, 6 * count(DISTINCT callee) FROM calls WHERE callee IN ('P1','P2','P3') GROUP BY file) GROUP BY file"""))
def ft14_relevant_tests(spark, sf_dir):
    s, c = symbols(spark, sf_dir), calls(spark, sf_dir)
    probes = s.filter(R.contains_text("file", "1")).groupBy("file").agg((F.lit(4) * F.count(ONE)).alias("score"))
    probes = probes.union(s.filter(R.contains_text("fq_name", "steel")).groupBy("file").agg(F.lit(3) * F.count(ONE)))
    probes = probes.union(c.filter(F.col("callee").isin("P1", "P2", "P3")).groupBy("file").agg(F.lit(6) * F.countDistinct("callee")))
    return probes.groupBy("file").agg(F.sum("score").alias("score"))


@query(sql("files", "calls", "deps", "endpoints", rest="""SELECT m.module, m.files, coalesce(d.dependents, 0) AS dependents, coalesce(c.callers, 0) AS callers, coalesce(e.n, 0) AS endpoints, least(m.tests, 5) AS tests,
 m.files + 2*coalesce(d.dependents,0) + coalesce(c.callers,0) + 5*coalesce(e.n,0) + least(m.tests,5) AS score, CASE WHEN coalesce(e.n,0) > 0 OR coalesce(c.callers,0) >= 10 OR m.files + 2*coalesce(d.dependents,0) + coalesce(c.callers,0) + 5*coalesce(e.n,0) + least(m.tests,5) >= 18 THEN 'high' WHEN m.files + 2*coalesce(d.dependents,0) + coalesce(c.callers,0) + 5*coalesce(e.n,0) + least(m.tests,5) >= 5 THEN 'medium' ELSE 'low' END AS radius
 FROM (SELECT doc_id % 400 AS module, count(*) AS files, count(*) FILTER (role = 'test_source') AS tests FROM files GROUP BY 1) m LEFT JOIN (SELECT b AS module, count(*) AS dependents FROM deps GROUP BY b) d USING (module)
 LEFT JOIN (SELECT substr(callee,2)::BIGINT AS module, count(DISTINCT caller) AS callers FROM calls WHERE tier = 'provider' GROUP BY 1) c USING (module) LEFT JOIN (SELECT id * 3 AS module, count(*) AS n FROM endpoints GROUP BY 1) e USING (module)"""))
def patch_blast_radius(spark, sf_dir):
    m = files(spark, sf_dir).groupBy((F.col("doc_id") % 400).alias("module")).agg(F.count(ONE).alias("files"), F.count_if(F.col("role") == "test_source").alias("tests"))
    d = dependencies(spark, sf_dir).groupBy(F.col("b").alias("module")).agg(F.count(ONE).alias("dependents"))
    c = calls(spark, sf_dir).filter("tier = 'provider'").groupBy(F.expr("cast(substring(callee, 2) AS bigint)").alias("module")).agg(F.countDistinct("caller").alias("callers"))
    e = endpoints(spark, sf_dir).groupBy((F.col("id") * 3).alias("module")).agg(F.count(ONE).alias("endpoints"))
    return I.blast_radius(m.join(d, "module", "left").join(c, "module", "left").join(e, "module", "left").fillna(0))


@query(sql("log", rest="""SELECT day, tool, n, total FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, tool) AS rn FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, tool, count(*) AS n, round(sum(duration_ms), 4) AS total FROM log GROUP BY ALL)) WHERE rn <= 3"""))
def tg07_usage_by_day(spark, sf_dir):
    n = query_log(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "tool").agg(F.count(ONE).alias("n"), F.round(F.sum("duration_ms"), 4).alias("total"))
    return R.top_per_key(n, ["day"], [F.desc("n"), F.col("tool")], 3).select("day", "tool", "n", "total")


@query(sql("log", rest="SELECT session, tool, id FROM (SELECT *, row_number() OVER (PARTITION BY session, tool ORDER BY ts DESC, id DESC) AS rn FROM log WHERE ts + INTERVAL 10 DAY > (SELECT max(ts) FROM log)) WHERE rn = 1"))
def tg08_live_cache(spark, sf_dir):
    log = query_log(spark, sf_dir)
    live = log.filter(F.col("ts") + F.expr("INTERVAL 10 DAYS") > log.agg(F.max("ts")).scalar())
    return R.top_per_key(live, ["session", "tool"], [F.desc("ts"), F.desc("id")], 1).select("session", "tool", "id")


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS generic, ceil(length(text) / 3.8)::BIGINT AS code, ceil(length(text) / 5.2)::BIGINT AS json FROM documents")
def fn_token_estimates(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", *(F.expr(f"cast(ceil(length(text) / {ratio}D) AS bigint)").alias(kind) for kind, ratio in (("generic", 4.0), ("code", 3.8), ("json", 5.2))))


@query(sql("endpoints", rest="SELECT id, '/' || trim(regexp_replace('api/v1' || '/' || path || '/', '/+', '/', 'g'), '/') AS composed FROM endpoints"))
def fn_endpoint_paths(spark, sf_dir):
    return endpoints(spark, sf_dir).select("id", I.joined_path(F.lit("api/v1"), F.col("path")).alias("composed"))
