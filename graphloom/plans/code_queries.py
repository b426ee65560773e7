"""Queries over the code-intelligence tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import impact as I
from ..operators import relational as R
from ..operators import resolution as N
from ..operators.tables import calls, dependencies, endpoints, files, query_log, read, sql, symbols
from .registry import query

RANK = "CASE tier WHEN 'provider' THEN 0 WHEN 'primary' THEN 1 ELSE 2 END"


@query(sql("calls", rest="SELECT callee, count(*) AS in_degree, count(*) FILTER (tier = 'primary') AS n_primary, count(*) FILTER (tier = 'provider') AS n_provider, max(confidence) AS best FROM calls WHERE tier IN ('primary','provider') GROUP BY callee"))
def ag05_call_in_degree(spark, sf_dir):
    c = R.visible_calls(calls(spark, sf_dir))
    return c.groupBy("callee").agg(F.count(F.lit(1)).alias("in_degree"), F.count_if(F.col("tier") == "primary").alias("n_primary"), F.count_if(F.col("tier") == "provider").alias("n_provider"), F.max("confidence").alias("best"))


@query(sql("files", rest="SELECT path, language, size FROM files WHERE role NOT IN ('test_source','generated','mock_source') AND language = 'en'"))
def flt02_visible_files(spark, sf_dir):
    return R.visible_files(files(spark, sf_dir)).filter("language = 'en'").select("path", "language", "size")


@query(sql("symbols", rest="SELECT fq_name, kind, file FROM symbols WHERE kind IN ('class','interface','enum','type') AND lower(fq_name) LIKE '%a\\_%' ESCAPE '\\' OR kind = 'method' AND lower(fq_name) LIKE '%brand#1%'"))
def flt09_like_escaped(spark, sf_dir):
    s = symbols(spark, sf_dir)
    kinds = F.col("kind").isin("class", "interface", "enum", "type")
    return s.filter((kinds & R.contains_text("fq_name", "a_")) | ((F.col("kind") == "method") & R.contains_text("fq_name", "Brand#1"))).select("fq_name", "kind", "file")


@query(sql("files", rest="SELECT role, language, count(*) AS n, sum(size) AS bytes FROM files GROUP BY role, language"))
def ag02_group_counts(spark, sf_dir):
    return files(spark, sf_dir).groupBy("role", "language").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(sql("files", "symbols", "calls", rest="""SELECT (SELECT count(*) FROM files) AS n_files, (SELECT count(*) FILTER (role = 'test_source') FROM files) AS n_tests, (SELECT count(DISTINCT blob_hash) FROM files) AS n_blobs,
 (SELECT count(*) FROM symbols) AS n_symbols, (SELECT count(*) FILTER (kind = 'class') FROM symbols) AS n_classes, (SELECT count(*) FROM calls) AS n_calls, (SELECT count(*) FILTER (tier = 'low_signal') FROM calls) AS n_low_signal"""))
def ag01_snapshot_counters(spark, sf_dir):
    f = files(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("role") == "test_source").alias("n_tests"), F.countDistinct("blob_hash").alias("n_blobs"))
    s = symbols(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_symbols"), F.count_if(F.col("kind") == "class").alias("n_classes"))
    c = calls(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("tier") == "low_signal").alias("n_low_signal"))
    one = F.lit(1).alias("one")  # three single rows side by side
    return f.select("*", one).join(s.select("*", one), "one").join(c.select("*", one), "one").drop("one")


@query(sql("symbols", rest="SELECT 'kind' AS dim, kind AS value, count(*) AS n FROM symbols GROUP BY kind UNION ALL SELECT 'file', file, count(*) FROM symbols GROUP BY file UNION ALL SELECT 'name', name, count(*) FROM symbols GROUP BY name"))
def ag08_facets(spark, sf_dir):
    return R.facets(symbols(spark, sf_dir), ["kind", "file", "name"])


@query(sql("deps", rest="SELECT b AS file, count(DISTINCT a) AS in_degree FROM deps GROUP BY b"))
def ag06_file_in_degree(spark, sf_dir):
    return dependencies(spark, sf_dir).groupBy(F.col("b").alias("file")).agg(F.countDistinct("a").alias("in_degree"))


@query(sql("calls", rest="SELECT caller, callee, count(*) AS n, min(line) AS first_line, max(confidence) AS best, count(DISTINCT file) AS n_files FROM calls GROUP BY caller, callee"))
def ag13_coalesced_edges(spark, sf_dir):
    return calls(spark, sf_dir).groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"), F.max("confidence").alias("best"), F.countDistinct("file").alias("n_files"))


@query(sql("calls", rest="SELECT file AS key, count(*) AS n, count(DISTINCT tier) AS n_tiers, string_agg(DISTINCT tier, ',' ORDER BY tier) AS tiers FROM calls GROUP BY file"))
def ag09_reference_groups(spark, sf_dir):
    return calls(spark, sf_dir).groupBy(F.col("file").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tier").alias("n_tiers"), F.array_join(F.sort_array(F.collect_set("tier")), ",").alias("tiers"))


@query(sql("files", rest="SELECT language, count(*) AS n_files, sum(size) AS bytes FROM files GROUP BY language ORDER BY bytes DESC, language LIMIT 20"))
def ag15_language_summary(spark, sf_dir):
    return files(spark, sf_dir).groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes")).orderBy(F.desc("bytes"), "language").limit(20)


@query(sql("files", rest="SELECT module, count(*) AS n_files, sum(size) AS bytes, count(*) FILTER (role = 'main_source') AS n_main, max(path) FILTER (rn = 1) AS top_file FROM (SELECT *, split_part(path,'/',1)||'/'||split_part(path,'/',2) AS module, row_number() OVER (PARTITION BY split_part(path,'/',1)||'/'||split_part(path,'/',2) ORDER BY size DESC, path) AS rn FROM files) GROUP BY module"))
def ag16_module_rollup(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("module", F.substring_index("path", "/", 2))
    f = f.groupBy("module").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"), F.count_if(F.col("role") == "main_source").alias("n_main"), F.min(F.struct(-F.col("size"), "path")).alias("top"))
    return f.select("module", "n_files", "bytes", "n_main", F.col("top.path").alias("top_file"))


@query(sql("symbols", "calls", rest="""SELECT c.file AS from_file, s.file AS to_file, sum(c.n) AS edge_count, max(c.best) AS confidence FROM (SELECT file, callee, count(*) AS n, max(confidence) AS best FROM calls WHERE tier <> 'low_signal' GROUP BY ALL) c
 JOIN (SELECT 'P'||id AS callee, min(file) AS file FROM symbols GROUP BY 1) s USING (callee) WHERE s.file <> c.file GROUP BY ALL"""))
def jn04_module_call_edges(spark, sf_dir):
    c = calls(spark, sf_dir).filter("tier <> 'low_signal'").groupBy(F.col("file").alias("from_file"), "callee").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("best"))
    s = symbols(spark, sf_dir).groupBy(F.concat(F.lit("P"), F.col("id")).alias("callee")).agg(F.min("file").alias("to_file"))
    return c.join(s, "callee").filter("from_file <> to_file").groupBy("from_file", "to_file").agg(F.sum("n").alias("edge_count"), F.max("best").alias("confidence"))


@query(sql("symbols", "calls", "deps", rest="""SELECT s.id, coalesce(i.n,0) AS n_in, coalesce(o.n,0) AS n_out, coalesce(c.n,0) AS n_calls, 3*coalesce(i.n,0) + 2*coalesce(o.n,0) + 2*coalesce(c.n,0) AS risk FROM symbols s
 LEFT JOIN (SELECT b AS id, count(*) AS n FROM deps GROUP BY b) i USING (id) LEFT JOIN (SELECT a AS id, count(*) AS n FROM deps GROUP BY a) o USING (id)
 LEFT JOIN (SELECT substr(callee,2)::BIGINT AS id, count(*) AS n FROM calls WHERE tier <> 'low_signal' GROUP BY 1) c USING (id)"""))
def jn03_hotspots(spark, sf_dir):
    d, n = dependencies(spark, sf_dir), F.count(F.lit(1))
    ends = d.select(F.explode(F.array(F.struct(F.col("b").alias("id"), F.lit(1).alias("i")), F.struct(F.col("a").alias("id"), F.lit(0).alias("i")))).alias("x")).select("x.*")
    out = symbols(spark, sf_dir).select("id").join(ends.groupBy("id").agg(F.sum("i").alias("n_in"), (n - F.sum("i")).alias("n_out")), "id", "left")
    c = R.visible_calls(calls(spark, sf_dir)).groupBy(F.expr("cast(substring(callee, 2) AS bigint)").alias("id")).agg(n.alias("n_calls"))
    out = out.join(c, "id", "left").fillna(0)
    return out.withColumn("risk", F.expr("3 * n_in + 2 * n_out + 2 * n_calls"))


@query(sql("symbols", "files", rest="SELECT name, fq_name FROM (SELECT name, min(fq_name) AS fq_name, count(*) AS c FROM (SELECT split_part(fq_name,'.',1)||'/'||(id % 50) AS name, fq_name FROM symbols) GROUP BY name) WHERE c = 1"))
def jn09_unique_names(spark, sf_dir):
    s = symbols(spark, sf_dir).select(F.concat(F.split_part("fq_name", F.lit("."), F.lit(1)), F.lit("/"), F.col("id") % 50).alias("name"), "fq_name")
    return R.unique_match(s, "name", "fq_name")


@query(sql("symbols", "calls", rest="""WITH own AS (SELECT fq_name, 'P'||(id % 300) AS name, file FROM symbols WHERE kind IN ('method', 'enum') AND id % 10 > 2), c AS (SELECT file, caller, line, tier, confidence, CASE WHEN line = 3 THEN 'x.'||callee ELSE callee END AS callee, CASE WHEN line % 5 = 0 THEN 'import' ELSE 'name-only' END AS resolution FROM calls),
 k AS (SELECT *, tier = 'primary' AND resolution = 'name-only' AND NOT contains(callee, '.') AS bare FROM c), l AS (SELECT file, name, min(fq_name) AS fq FROM own GROUP BY ALL), g AS (SELECT name, min(fq_name) AS fq FROM own GROUP BY name HAVING count(*) = 1)
 SELECT k.file, k.caller, k.line, CASE WHEN bare THEN coalesce(l.fq, g.fq, callee) ELSE callee END AS callee, CASE WHEN bare AND l.fq IS NOT NULL THEN 'name-local' WHEN bare AND g.fq IS NOT NULL THEN 'name-unique' ELSE resolution END AS resolution, CASE WHEN bare AND l.fq IS NOT NULL THEN 0.8::DOUBLE WHEN bare AND g.fq IS NOT NULL THEN 0.75::DOUBLE ELSE confidence END AS confidence
 FROM k LEFT JOIN l ON l.file = k.file AND l.name = k.callee LEFT JOIN g ON g.name = k.callee"""))
def gr21_bare_name_resolution(spark, sf_dir):
    c = calls(spark, sf_dir).withColumns({"callee": F.expr("CASE WHEN line = 3 THEN concat('x.', callee) ELSE callee END"), "resolution": F.expr("CASE WHEN line % 5 = 0 THEN 'import' ELSE 'name-only' END")})
    s = symbols(spark, sf_dir).selectExpr("fq_name", "concat('P', id % 300) AS name", "CASE kind WHEN 'enum' THEN 'function' ELSE kind END AS kind", "file", "CASE WHEN id % 10 = 0 THEN 'test_source' WHEN id % 10 < 3 THEN 'mock_source' WHEN id % 10 = 3 THEN 'generated' ELSE 'main_source' END AS role")
    return N.bare_names(c, s).select("file", "caller", "line", "callee", "resolution", "confidence")


@query(sql("symbols", rest="""WITH pts AS (SELECT DISTINCT 'src/'||(l_orderkey % 97)||'.java' AS file, (l_orderkey % 61)::BIGINT AS pos FROM lineitem), x AS (SELECT p.file, p.pos, s.*, s.line <= p.pos AND s.end_line >= p.pos AS holds FROM pts p JOIN symbols s ON s.file = p.file),
 r AS (SELECT *, row_number() OVER (PARTITION BY file, pos ORDER BY CASE WHEN holds THEN 0 ELSE 1 END, CASE WHEN holds THEN CASE kind WHEN 'method' THEN 0 WHEN 'field' THEN 1 WHEN 'class' THEN 2 WHEN 'interface' THEN 3 WHEN 'enum' THEN 4 ELSE 5 END ELSE 0 END, CASE WHEN holds THEN end_line - line ELSE abs(line - pos) END, CASE WHEN holds THEN -line ELSE line END, fq_name) AS rn FROM x)
 SELECT file, pos, fq_name, kind, CASE WHEN holds THEN 'containing' ELSE 'nearest' END AS how FROM r WHERE rn = 1""").replace("s.*,", "s.fq_name, s.kind, s.line, s.end_line,"))
def jn11_containing_symbol(spark, sf_dir):
    pts = read(spark, sf_dir, "lineitem").selectExpr("concat('src/', l_orderkey % 97, '.java') AS file", "cast(l_orderkey % 61 AS bigint) AS pos").distinct()
    return R.containing(pts, symbols(spark, sf_dir).select("fq_name", "kind", "line", "end_line", "file"), at="pos")


@query(sql("calls", "symbols", rest="SELECT DISTINCT callee FROM calls WHERE substr(callee, 2)::BIGINT NOT IN (SELECT id FROM symbols WHERE kind <> 'field')"))
def jn16_unresolved(spark, sf_dir):
    known = symbols(spark, sf_dir).filter("kind <> 'field'").select(F.concat(F.lit("P"), F.col("id")).alias("callee"))
    return calls(spark, sf_dir).select("callee").distinct().join(known, "callee", "left_anti")


@query(sql("calls", rest="SELECT caller, file, count(*) AS n FROM calls WHERE callee IN (SELECT DISTINCT callee FROM calls WHERE file = 'src/7.java') AND file <> 'src/7.java' GROUP BY caller, file"))
def jn18_stale_callers(spark, sf_dir):
    c = calls(spark, sf_dir)
    changed = c.filter("file = 'src/7.java'").select("callee").distinct()
    return c.filter("file <> 'src/7.java'").join(changed, "callee", "left_semi").groupBy("caller", "file").agg(F.count(F.lit(1)).alias("n"))


@query(sql("files", rest="WITH roots AS (SELECT DISTINCT split_part(path,'/',1) AS root FROM files UNION SELECT DISTINCT split_part(path,'/',1)||'/'||language FROM files WHERE language <> 'en'), m AS (SELECT path, root, row_number() OVER (PARTITION BY path ORDER BY length(root) DESC) AS rn FROM files JOIN roots ON starts_with(path, root||'/')) SELECT path, root FROM m WHERE rn = 1"))
def jn20_longest_prefix(spark, sf_dir):
    f = files(spark, sf_dir)
    roots = f.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("root")).union(f.filter("language <> 'en'").select(F.substring_index("path", "/", 2))).distinct()
    return R.longest_prefix(f, roots)


SNAP_B = "SELECT path, CASE WHEN doc_id % 7 = 0 THEN sha256(upper(text)) ELSE sha256(text) END AS blob_hash FROM (SELECT source||'/'||lang||'/doc_'||doc_id AS path, * FROM documents) WHERE doc_id % 10 <> 0"


def _after(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter("doc_id % 10 <> 0")
    return d.selectExpr("concat(source, '/', lang, '/doc_', doc_id) AS path", "CASE WHEN doc_id % 7 = 0 THEN sha2(upper(text), 256) ELSE sha2(text, 256) END AS blob_hash")


@query(sql("files", rest=f"WITH b AS ({SNAP_B}) SELECT path, CASE WHEN a.blob_hash IS NULL THEN 'added' WHEN b.blob_hash IS NULL THEN 'deleted' WHEN a.blob_hash <> b.blob_hash THEN 'modified' ELSE 'unchanged' END AS change FROM (SELECT path, blob_hash FROM files) a FULL JOIN b USING (path)"))
def jn21_snapshot_diff(spark, sf_dir):
    return R.snapshot_diff(_after(spark, sf_dir), files(spark, sf_dir))


@query(sql("files", rest=f"WITH b AS ({SNAP_B}) SELECT path, role, size FROM files WHERE (path, blob_hash) IN (SELECT path, blob_hash FROM b)"))
def jn13_carry_forward(spark, sf_dir):
    f = files(spark, sf_dir)
    return R.carry_forward(f.select("path", "role", "size"), f, _after(spark, sf_dir))


@query(sql("calls", rest=f"SELECT callee, caller, file, line, confidence, tier, rn FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY {RANK}, confidence DESC, file, line, caller) AS rn FROM calls) WHERE rn <= 5"))
def wn02_top_callers(spark, sf_dir):
    order = [R.rank_of("tier", ("provider", "primary")), F.desc("confidence"), F.col("file"), F.col("line"), F.col("caller")]
    return R.top_per_key(calls(spark, sf_dir), ["callee"], order, 5).select("callee", "caller", "file", "line", "confidence", "tier", "rn")


@query(sql("log", rest="SELECT session, tool AS first_tool, ts FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, id) AS rn FROM log) WHERE rn = 1"))
def wn03_first_event(spark, sf_dir):
    first = F.min(F.struct("ts", "id", "tool")).alias("x")
    return query_log(spark, sf_dir).groupBy("session").agg(first).select("session", F.col("x.tool").alias("first_tool"), F.col("x.ts").alias("ts"))


@query(sql("log", rest="""WITH r AS (SELECT session, id, duration_ms, row_number() OVER (PARTITION BY session ORDER BY duration_ms DESC, id) AS rn, count(*) OVER (PARTITION BY session) AS n FROM log), t AS (SELECT *, max(duration_ms) OVER (PARTITION BY session) AS s1, max(CASE WHEN rn = 2 THEN duration_ms END) OVER (PARTITION BY session) AS s2 FROM r)
 SELECT session, id, rn FROM t WHERE n <= 1 OR s1 <= 0 OR rn <= 1 OR duration_ms >= (CASE WHEN s2 > 0 AND s1 / s2 >= 1.4 THEN s2 ELSE s1 END) * 0.8"""))
def wn04_right_sizing(spark, sf_dir):
    return R.right_size(query_log(spark, sf_dir), ["session"], "duration_ms").select("session", "id", "rn")


@query(sql("calls", rest=f"SELECT caller, callee, file, line, confidence FROM calls WHERE callee = 'P7' ORDER BY {RANK}, confidence DESC, file, line, caller LIMIT 20 OFFSET 5"))
def wn07_callers_page(spark, sf_dir):
    order = [R.rank_of("tier", ("provider", "primary")), F.desc("confidence"), F.col("file"), F.col("line"), F.col("caller")]
    return R.page(calls(spark, sf_dir).filter("callee = 'P7'"), order, 5, 20).select("caller", "callee", "file", "line", "confidence")


@query(sql("calls", rest=f"SELECT pass, caller, callee, file, line, confidence FROM (SELECT CASE WHEN callee = 'P17' THEN 0 ELSE 1 END AS pass, * FROM calls WHERE tier <> 'low_signal' AND contains(lower(callee), 'p17')) ORDER BY pass, {RANK}, confidence DESC, file, line, caller, callee LIMIT 100"))
def gr02_callers_exact_first(spark, sf_dir):
    c = R.visible_calls(calls(spark, sf_dir)).filter(R.contains_text("callee", "P17")).withColumn("pass", F.when(F.col("callee") == "P17", 0).otherwise(1))
    order = [F.col("pass"), R.rank_of("tier", ("provider", "primary")), F.desc("confidence"), F.col("file"), F.col("line"), F.col("caller"), F.col("callee")]
    return c.orderBy(*order).limit(100).select("pass", "caller", "callee", "file", "line", "confidence")


REF = """SELECT 'definition' AS kind, file, line, fq_name AS name, NULL::VARCHAR AS caller FROM symbols WHERE id % 100 = 7 UNION ALL SELECT 'call', file, line, callee, caller FROM calls WHERE callee = 'P7' UNION ALL SELECT 'import', 'src/'||(a % 97)||'.java', NULL::BIGINT, 'P'||b, NULL FROM deps WHERE b = 7"""


@query(sql("symbols", "calls", "deps", rest=REF))
def st01_references(spark, sf_dir):
    d = symbols(spark, sf_dir).filter("id % 100 = 7").select(F.lit("definition").alias("kind"), "file", "line", F.col("fq_name").alias("name"))
    c = calls(spark, sf_dir).filter("callee = 'P7'").select(F.lit("call").alias("kind"), "file", "line", F.col("callee").alias("name"), "caller")
    i = dependencies(spark, sf_dir).filter("b = 7").select(F.lit("import").alias("kind"), F.concat(F.lit("src/"), F.col("a") % 97, F.lit(".java")).alias("file"), F.concat(F.lit("P"), F.col("b")).alias("name"))
    return d.unionByName(c, allowMissingColumns=True).unionByName(i, allowMissingColumns=True)


@query("""WITH l AS (SELECT DISTINCT doc_id, trim(x, ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)), f AS (SELECT * FROM l WHERE length(line) >= 8 AND NOT regexp_full_match(line, '[\\[\\](){};,\\s]*')),
 n AS (SELECT doc_id, count(*) AS n, list_sort(list(line)) AS h FROM f GROUP BY doc_id), r AS (SELECT h, min(doc_id) AS doc_id, any_value(n) AS n FROM n GROUP BY h), g AS (SELECT f.*, r.n FROM f JOIN r USING (doc_id)),
 s AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS shared FROM g x JOIN g y USING (line) WHERE x.doc_id < y.doc_id GROUP BY ALL)
 SELECT a, b, shared, round(shared / least(na, nb), 6) AS ratio FROM s WHERE shared >= 4 AND shared / least(na, nb) >= 0.6""")
def st04_shared_lines(spark, sf_dir):
    return R.shared_lines(read(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH f AS (SELECT DISTINCT d.doc_id, trim(u.x, ' ') AS line FROM documents d, unnest(string_split(d.text, chr(10))) AS u(x) WHERE length(trim(u.x, ' ')) >= 8 AND regexp_matches(trim(u.x, ' '), '[^\\[\\](){};,\\s]')),
 n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id), s AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM f x JOIN f y USING (line) GROUP BY ALL)
 SELECT s.a AS doc_id, min(s.b) AS representative, any_value(na.n) AS n_lines, count(*) AS class_size FROM s JOIN n na ON na.doc_id = s.a JOIN n nb ON nb.doc_id = s.b WHERE s.shared = na.n AND s.shared = nb.n GROUP BY s.a""")
def st04_line_set_members(spark, sf_dir):
    return R.line_set_members(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(sql("deps", rest="--recursive WITH walk AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT d.b, w.depth + 1 FROM walk w JOIN deps d ON d.a = w.node WHERE w.depth < 3) SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node"))
def gr03_bfs_reach(spark, sf_dir):
    return G.reach(dependencies(spark, sf_dir), spark.range(1).select(F.col("id").alias("node")), 3)


@query(sql("deps", rest="--recursive WITH walk AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT d.b, w.depth + 1 FROM walk w JOIN deps d ON d.a = w.node WHERE w.depth < 1), n AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node) SELECT d.a, d.b, (n.depth + 1)::INT AS depth, coalesce(m.depth < n.depth + 1, false) AS cycle FROM deps d JOIN n ON n.node = d.a LEFT JOIN n m ON m.node = d.b"))
def gr03_trace_dependencies(spark, sf_dir):
    return G.trace(dependencies(spark, sf_dir), spark.range(1).select(F.col("id").alias("node")), 2)


@query(sql("deps", rest="--recursive WITH seeds AS (SELECT p_partkey AS node FROM part WHERE p_partkey IN (10, 11)), walk AS (SELECT node, 0 AS depth FROM seeds UNION SELECT d.a, w.depth + 1 FROM walk w JOIN deps d ON d.b = w.node WHERE w.depth < 1), n AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node), m AS (SELECT d.a, n.depth + 1 AS distance, n.node FROM deps d JOIN n ON n.node = d.b WHERE d.a % 10 IN (0, 3)), k AS (SELECT a, min(distance) AS distance FROM m GROUP BY a) SELECT m.a AS node, k.distance::INT AS distance, min(m.node) AS via FROM m JOIN k ON k.a = m.a AND k.distance = m.distance GROUP BY ALL"))
def gr09_affected_tests(spark, sf_dir):
    roles = read(spark, sf_dir, "part").selectExpr("p_partkey AS node", "CASE p_partkey % 10 WHEN 0 THEN 'test_source' WHEN 3 THEN 'mock_source' ELSE 'main_source' END AS role")
    return G.affected_tests(dependencies(spark, sf_dir), roles, spark.range(10, 12).select(F.col("id").alias("node")), 2)


@query(sql("deps", "calls", "endpoints", rest="""WITH e AS (SELECT id, count(*) AS n FROM endpoints GROUP BY id), x AS (SELECT p_partkey AS id, 'P'||p_partkey AS target, (SELECT count(DISTINCT a) FROM deps WHERE b = p_partkey) AS dependents, least(100, (SELECT count(*) FROM calls WHERE tier <> 'low_signal' AND callee = 'P'||p_partkey)) AS callers,
 coalesce((SELECT sum(e.n) FROM e WHERE e.id IN (SELECT a FROM deps WHERE b = p_partkey)), 0)::BIGINT AS endpoints FROM part) SELECT target, dependents, callers, endpoints, dependents + callers + endpoints AS score, CASE WHEN dependents + callers + endpoints >= 10 THEN 'high' WHEN dependents + callers + endpoints >= 3 THEN 'medium' ELSE 'low' END AS radius FROM x"""))
def gr05_impact_radius(spark, sf_dir):
    t = read(spark, sf_dir, "part").selectExpr("concat('P', p_partkey) AS target", "p_partkey AS file")
    c = R.visible_calls(calls(spark, sf_dir)).withColumn("callee", F.expr("CASE WHEN line % 2 = 0 THEN concat('x.y.', callee, '(int)') ELSE callee END"))
    return I.impact_radius(t, dependencies(spark, sf_dir), c, endpoints(spark, sf_dir).select(F.col("id").alias("file")))


@query(sql("deps", rest="WITH seeds AS (SELECT a AS id FROM deps WHERE a < 20 GROUP BY a) SELECT b AS neighbour, count(DISTINCT a) AS n_seeds FROM deps WHERE a IN (SELECT id FROM seeds) AND b NOT IN (SELECT id FROM seeds) GROUP BY b"))
def gr11_neighbours(spark, sf_dir):
    d = dependencies(spark, sf_dir)
    seeds = d.filter("a < 20").select("a").distinct()
    near = d.join(seeds, "a", "left_semi").join(seeds.toDF("b"), "b", "left_anti")
    return near.groupBy(F.col("b").alias("neighbour")).agg(F.countDistinct("a").alias("n_seeds"))


@query(sql("deps", rest="SELECT node, count(*) AS degree FROM (SELECT a AS node FROM deps UNION ALL SELECT b FROM deps) GROUP BY node"))
def gr13_degrees(spark, sf_dir):
    return G.degrees(dependencies(spark, sf_dir))


@query("SELECT 'c'||c_custkey AS child, 'n'||c_nationkey AS ancestor, 1 AS depth FROM customer UNION ALL SELECT 'n'||n_nationkey, 'r'||n_regionkey, 1 FROM nation UNION ALL SELECT 'c'||c_custkey, 'r'||n_regionkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey")
def gr20_ancestors(spark, sf_dir):
    c = read(spark, sf_dir, "customer").selectExpr("concat('c', c_custkey) AS child", "concat('n', c_nationkey) AS parent")
    n = read(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS child", "concat('r', n_regionkey) AS parent")
    return G.ancestors(c.union(n))


@query("""WITH im AS (SELECT DISTINCT 'I' || (c_nationkey % 20) AS i, 'K' || (c_custkey % 90) AS k FROM customer), me AS (SELECT DISTINCT 'K' || (c_custkey % 110) AS k, c_mktsegment AS m FROM customer WHERE c_acctbal > 5000), t AS (SELECT i, k, m, count(*) OVER (PARTITION BY i, m) AS n FROM im JOIN me USING (k)),
 c AS (SELECT 'O' || o_orderkey AS caller, 'I' || (o_custkey % 25) || '.' || CASE o_orderkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'none' END AS callee, 0.4::DOUBLE AS confidence, 'primary' AS tier FROM orders)
 SELECT caller, callee, confidence, tier, NULL::BIGINT AS fanout FROM c UNION ALL SELECT c.caller, t.k || '.' || t.m, CASE WHEN n = 1 THEN 0.65 ELSE round(greatest(0.2, least(0.5, 0.6 / n)), 6) END, CASE WHEN n = 1 THEN 'primary' ELSE 'low_signal' END, n FROM c JOIN t ON c.callee = t.i || '.' || t.m""")
def gr19_interface_fanout(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    made = read(spark, sf_dir, "orders").selectExpr("concat('O', o_orderkey) AS caller", "concat('I', o_custkey % 25, '.', CASE o_orderkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'none' END) AS callee", "0.4D AS confidence", "'primary' AS tier")
    out = I.interface_fanout(made, c.selectExpr("concat('I', c_nationkey % 20) AS interface", "concat('K', c_custkey % 90) AS implementor"), c.filter("c_acctbal > 5000").selectExpr("concat('K', c_custkey % 110) AS owner", "c_mktsegment AS method"))
    return out.withColumn("confidence", F.round("confidence", 6))


@query(sql("endpoints", rest="SELECT method, path, count(*) AS n FROM endpoints WHERE method IN ('GET','POST') GROUP BY method, path"))
def flt08_find_endpoints(spark, sf_dir):
    return endpoints(spark, sf_dir).filter(F.col("method").isin("GET", "POST")).groupBy("method", "path").agg(F.count(F.lit(1)).alias("n"))


@query(sql("log", rest="SELECT tool, count(*) AS n, floor(sum(duration_ms) / count(*) + 0.5)::BIGINT AS avg_ms, max(duration_ms) AS max_ms, quantile_disc(duration_ms, 0.95) AS p95_ms FROM log GROUP BY tool"))
def ag18_log_summary(spark, sf_dir):
    return query_log(spark, sf_dir).groupBy("tool").agg(F.count(F.lit(1)).alias("n"), T.half_up(F.sum("duration_ms") / F.count(F.lit(1))).alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").alias("p95_ms"))


@query(sql("log", rest="SELECT strftime(ts, '%Y-%m-%d') AS day, tool, count(*) AS n, count(DISTINCT session) AS sessions FROM log GROUP BY ALL"))
def ag19_adoption_by_day(spark, sf_dir):
    return query_log(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "tool").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("sessions"))


@query(sql("log", rest="SELECT count(*) AS calls, count(DISTINCT session) AS sessions, round(count(*) / count(DISTINCT session), 1) AS calls_per_session, (SELECT count(*) FROM (SELECT arg_min(tool, ts) AS t FROM log GROUP BY session) WHERE t = 'click') AS gate_first FROM log"))
def ag19_adoption(spark, sf_dir):
    per = query_log(spark, sf_dir).groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.min_by("tool", "ts").alias("t"))
    return per.agg(F.sum("n").alias("calls"), F.count(F.lit(1)).alias("sessions"), F.round(F.sum("n") / F.count(F.lit(1)), 1).alias("calls_per_session"), F.count_if(F.col("t") == "click").alias("gate_first"))


@query("SELECT id, k FROM (SELECT event_id AS id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL AND k > 50")
def src12_json_log(spark, sf_dir):
    k = F.get_json_object("args", "$.k").try_cast("bigint") if hasattr(F.col("args"), "try_cast") else F.get_json_object("args", "$.k").cast("bigint")
    return query_log(spark, sf_dir).select("id", k.alias("k")).filter("k > 50")


@query("SELECT conv_id AS session, turn, text AS key_text, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) > 1 AS reused FROM conversations")
def sm05_evidence_ledger(spark, sf_dir):
    again = F.row_number().over(W.partitionBy("conv_id", "text").orderBy("turn")) > 1
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", F.col("text").alias("key_text"), again.alias("reused"))


@query("SELECT p_partkey AS id, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g')) AS compact, CASE WHEN length(p_brand) > 4 THEN p_brand ELSE '' END AS brand, floor(p_retailprice + 0.5)::BIGINT AS price, ceil(length(p_name) / 4.0)::BIGINT AS tokens FROM part")
def fn_scalars(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.compact(F.col("p_name")).alias("compact"), F.when(F.length("p_brand") > 4, F.col("p_brand")).otherwise("").alias("brand"), T.half_up(F.col("p_retailprice")).alias("price"), T.estimated_tokens(F.col("p_name")).alias("tokens"))
