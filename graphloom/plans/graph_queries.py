"""Queries of traversal, resolution, modules, selection, review and measures that other modules leave out, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import architecture as A
from ..operators import graph as G
from ..operators import impact as I
from ..operators import relational as R
from ..operators import resolution as N
from ..operators import review as Q
from ..operators import selection as C
from ..operators.tables import calls, dependencies, endpoints, file_endpoints, files, read, search_files, search_symbols, sql, symbols
from .registry import query

ONE = "*"  # what a count counts
RANK = "CASE tier WHEN 'provider' THEN 0 WHEN 'primary' THEN 1 ELSE 2 END"


@query(sql("deps", rest="SELECT 'dependencies' AS way, a, b, confidence FROM (SELECT a, b, (a * 7 + b) % 10 / 10 AS confidence FROM deps WHERE a = 3 ORDER BY confidence DESC, b LIMIT 500) UNION ALL SELECT 'dependents', a, b, confidence FROM (SELECT a, b, (a * 7 + b) % 10 / 10 AS confidence FROM deps WHERE b = 3 ORDER BY confidence DESC, a LIMIT 500)"))
def gr01_direct_dependencies(spark, sf_dir):
    d = dependencies(spark, sf_dir).withColumn("confidence", (F.col("a") * 7 + F.col("b")) % 10 / 10)
    out = d.filter("a = 3").orderBy(F.desc("confidence"), "b").limit(500).select(F.lit("dependencies").alias("way"), "a", "b", "confidence")
    return out.union(d.filter("b = 3").orderBy(F.desc("confidence"), "a").limit(500).select(F.lit("dependents"), "a", "b", "confidence"))


@query(sql("calls", rest=f"SELECT pass, caller, callee, file, line, confidence FROM (SELECT CASE WHEN caller IN ('com.S3.P7', 'S3.P7', 'com.S3.P7(int)') THEN 0 ELSE 1 END AS pass, * FROM (SELECT CASE WHEN line % 2 = 0 THEN caller||'.P7' ELSE 'x.'||caller||'.P7x' END AS caller, callee, file, line, confidence, tier FROM calls WHERE tier <> 'low_signal') WHERE contains(lower(caller), 's3.p7')) ORDER BY pass, {RANK}, confidence DESC, file, line, caller, callee LIMIT 60"))
def gr02_callees_of_derived_terms(spark, sf_dir):
    c = R.visible_calls(calls(spark, sf_dir)).withColumn("caller", F.expr("CASE WHEN line % 2 = 0 THEN concat(caller, '.P7') ELSE concat('x.', caller, '.P7x') END"))
    return G.named_calls(c, "com.S3.P7(int)", "caller", 60).select("pass", "caller", "callee", "file", "line", "confidence")


@query(sql("deps", "files", rest="""WITH seeds AS (SELECT doc_id AS node FROM files WHERE contains(path, '/en/doc_1') ORDER BY path LIMIT 100), hid AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 10 IN (0, 1, 2)), d AS (SELECT a, b FROM deps WHERE b NOT IN (SELECT node FROM hid)), u AS (SELECT b AS a, a AS b FROM deps WHERE a NOT IN (SELECT node FROM hid)),
 t AS (SELECT 'dependencies' AS direction, d.a, d.b, 1 AS depth, d.b IN (SELECT node FROM seeds) AS cycle FROM d WHERE d.a IN (SELECT node FROM seeds) UNION ALL SELECT 'dependents', u.a, u.b, 1, u.b IN (SELECT node FROM seeds) FROM u WHERE u.a IN (SELECT node FROM seeds)) SELECT direction, a, b, depth, cycle FROM t ORDER BY depth, direction, a, b LIMIT 200"""))
def gr03_seeded_trace(spark, sf_dir):
    f = files(spark, sf_dir)
    seeds = G.seeds_of(f, "/en/doc_1").join(f.select("path", F.col("doc_id").alias("node")), "path").select("node")
    roles = read(spark, sf_dir, "part").selectExpr("p_partkey AS node", "CASE WHEN p_partkey % 10 = 0 THEN 'test_source' WHEN p_partkey % 10 = 1 THEN 'generated' WHEN p_partkey % 10 = 2 THEN 'mock_source' ELSE 'main_source' END AS role")
    return G.trace_both(dependencies(spark, sf_dir), seeds, 1, "both", roles, 200)


@query(sql("deps", rest="""WITH e AS (SELECT 'dependencies' AS direction, a, b, (a % 3 + 1)::INT AS depth FROM deps), n AS (SELECT direction, depth, count(*) AS n FROM e GROUP BY ALL), f AS (SELECT depth, file, row_number() OVER (PARTITION BY depth ORDER BY c DESC, file) AS rn FROM (SELECT depth, file, count(*) AS c FROM (SELECT depth, a AS file FROM e UNION ALL SELECT depth, b FROM e) GROUP BY ALL)),
 s AS (SELECT direction, depth, a||'>'||b AS x, row_number() OVER (PARTITION BY depth ORDER BY a, b) AS rn FROM e) SELECT n.direction, n.depth, n.n, ff.files, ss.samples FROM n JOIN (SELECT depth, string_agg(file::VARCHAR, ' ' ORDER BY rn) AS files FROM f WHERE rn <= 8 GROUP BY depth) ff ON ff.depth = n.depth JOIN (SELECT depth, string_agg(x, ' ' ORDER BY rn) AS samples FROM s WHERE rn <= 3 GROUP BY depth) ss ON ss.depth = n.depth"""))
def ag10_trace_groups(spark, sf_dir):
    e = dependencies(spark, sf_dir).select(F.lit("dependencies").alias("direction"), "a", "b", (F.col("a") % 3 + 1).cast("int").alias("depth"))
    return G.trace_groups(e)


@query(f"""WITH RECURSIVE c AS (SELECT 'K.m' || (l_partkey % 40) || 'x' AS caller, 'K.m' || ((l_partkey * 7 + l_linenumber) % 40) || 'x' AS callee, l_orderkey % 97 AS file, l_linenumber AS line, round(1 - l_discount * 5, 4) AS confidence, CASE l_returnflag WHEN 'A' THEN 'primary' ELSE 'provider' END AS tier FROM lineitem WHERE l_returnflag <> 'R'),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY {RANK}, confidence DESC, line, file, caller, callee) AS rn FROM c) WHERE rn <= 25),
 one AS (SELECT 1 AS level, caller AS name, rn, caller, callee, file, line, confidence FROM b WHERE caller = 'K.m3x'), two AS (SELECT 2 AS level, caller AS name, rn, caller, callee, file, line, confidence FROM b WHERE caller IN (SELECT callee FROM one) AND caller <> 'K.m3x' ORDER BY caller, rn LIMIT 100)
 SELECT level, caller, callee, file, line, confidence FROM (SELECT * FROM one UNION ALL SELECT * FROM two) ORDER BY level, name, rn LIMIT 100""")
def gr04_call_chain(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").selectExpr("concat('K.m', l_partkey % 40, 'x') AS caller", "concat('K.m', (l_partkey * 7 + l_linenumber) % 40, 'x') AS callee", "l_orderkey % 97 AS file", "l_linenumber AS line", "round(1 - l_discount * 5, 4) AS confidence", "CASE l_returnflag WHEN 'A' THEN 1 ELSE 0 END AS tier_rank")
    return G.call_chain(c, "K.m3x", 2)


@query(sql("symbols", "calls", "endpoints", rest="""SELECT s.id, s.fq_name, (SELECT count(*) FROM calls c WHERE c.callee = 'P'||s.id AND tier <> 'low_signal') AS n_callers, (SELECT count(*) FROM calls c WHERE c.caller = 'S'||s.id AND tier <> 'low_signal') AS n_callees, (SELECT count(*) FROM endpoints e WHERE 'src/'||(e.id % 97)||'.java' = s.file) AS n_endpoints,
 (SELECT count(DISTINCT c.file) FROM calls c WHERE c.callee = 'P'||s.id AND tier <> 'low_signal' AND c.file LIKE '%7.java') AS n_tests FROM symbols s WHERE contains(lower(s.name), 'bolt')"""))
def gr06_symbol_packet(spark, sf_dir):
    s = symbols(spark, sf_dir).filter(R.contains_text("name", "bolt"))
    c = R.visible_calls(calls(spark, sf_dir))
    e = endpoints(spark, sf_dir).selectExpr("concat('src/', id % 97, '.java') AS file")
    return I.symbol_packet(s.select("id", "fq_name", "file", F.concat(F.lit("P"), "id").alias("as_callee"), F.concat(F.lit("S"), "id").alias("as_caller")), c, e, F.col("file").endswith("7.java"))


_IMPORTS = "concat('src/', l_suppkey % 10, '/f', l_partkey % 200, '.ts') AS path, concat(CASE WHEN l_linenumber % 2 = 0 THEN './' ELSE '../' || (l_suppkey * 3 % 10) || '/./' END, 'f', (l_partkey * 3) % 200, CASE l_orderkey % 3 WHEN 0 THEN '.js' WHEN 1 THEN '' ELSE '.tsx' END) AS specifier"
_TS = "concat('src/', p_partkey % 10, '/f', p_partkey % 200, CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '/index.ts' ELSE '.js' END) AS path"


@query(f"""WITH i AS (SELECT DISTINCT {_IMPORTS} FROM lineitem), f AS (SELECT DISTINCT {_TS} FROM part), r AS (SELECT path, specifier, CASE WHEN starts_with(specifier, '../') THEN 'src/' || replace(substr(specifier, 4), '/./', '/') ELSE regexp_extract(path, '^(.*/)', 1) || substr(specifier, 3) END AS whole FROM i),
 b AS (SELECT *, regexp_replace(whole, '[.](js|tsx)$', '') AS bare FROM r), c AS (SELECT path, specifier, unnest([whole, bare || '.ts', bare || '.tsx', bare || '.js', bare || '.jsx', bare || '/index.ts', bare || '/index.tsx', bare || '/index.js']) AS target, unnest(range(8)) AS k FROM b)
 SELECT DISTINCT importer, target FROM (SELECT c.path AS importer, c.target, row_number() OVER (PARTITION BY c.path, c.specifier ORDER BY k) AS rn FROM c JOIN f ON f.path = c.target) WHERE rn = 1 AND importer <> target""")
def gr08_import_graph(spark, sf_dir):
    i = read(spark, sf_dir, "lineitem").selectExpr(*(x.strip() for x in ("concat('src/', l_suppkey % 10, '/f', l_partkey % 200, '.ts') AS path", "concat(CASE WHEN l_linenumber % 2 = 0 THEN './' ELSE concat('../', l_suppkey * 3 % 10, '/./') END, 'f', (l_partkey * 3) % 200, CASE l_orderkey % 3 WHEN 0 THEN '.js' WHEN 1 THEN '' ELSE '.tsx' END) AS specifier"))).distinct()
    return I.import_graph(i, read(spark, sf_dir, "part").selectExpr(_TS).distinct())


_CHANGE = "concat(source, '/', lang, '/doc_', doc_id, CASE doc_id % 15 WHEN 3 THEN '.md' WHEN 6 THEN '.sql' ELSE '' END) AS path, CASE WHEN doc_id % 11 = 0 THEN 'D' ELSE 'M' END AS status"


@query(sql("files", rest=f"""SELECT c.path, CASE WHEN c.path LIKE '%.md' THEN 'ignored' WHEN c.status = 'D' THEN 'deleted' WHEN f.role IN ('build_config', 'resource_config') OR c.path LIKE '%.sql' THEN 'configuration' WHEN f.role IS NULL THEN 'unknown' ELSE 'traced' END AS decision
 FROM (SELECT {_CHANGE.replace("concat(source, '/', lang, '/doc_', doc_id,", "concat(source, '/', lang, '/doc_', doc_id,")} FROM documents WHERE doc_id % 4 = 1) c LEFT JOIN files f ON f.path = c.path"""))
def gr10_changed_paths(spark, sf_dir):
    ch = read(spark, sf_dir, "documents").filter("doc_id % 4 = 1").selectExpr("concat(source, '/', lang, '/doc_', doc_id, CASE doc_id % 15 WHEN 3 THEN '.md' WHEN 6 THEN '.sql' ELSE '' END) AS path", "CASE WHEN doc_id % 11 = 0 THEN 'D' ELSE 'M' END AS status")
    return C.changed_paths(ch, files(spark, sf_dir)).select("path", "decision")


_CI = "part_files AS (SELECT 'p' || p_partkey AS path, CASE p_partkey % 10 WHEN 0 THEN 'test_source' WHEN 3 THEN 'build_config' ELSE 'main_source' END AS role FROM part), e AS (SELECT 'p' || a AS a, 'p' || b AS b FROM deps), ch AS (SELECT 'p' || p_partkey AS path FROM part WHERE p_partkey IN (11, 20, 33, 47)), tr AS (SELECT path, role FROM ch JOIN part_files USING (path) WHERE role <> 'build_config'), w AS (SELECT path AS node, 0 AS depth FROM tr UNION SELECT e.a, w.depth + 1 FROM w JOIN e ON e.b = w.node WHERE w.depth < 2), n AS (SELECT node, min(depth) AS depth FROM w GROUP BY node), m AS (SELECT e.a, n.depth + 1 AS distance, n.node FROM e JOIN n ON n.node = e.b JOIN part_files p ON p.path = e.a WHERE p.role = 'test_source' AND n.depth < 2), k AS (SELECT a, min(distance) AS distance FROM m GROUP BY a), r AS (SELECT m.a AS path, k.distance, min(m.node) AS via FROM m JOIN k ON k.a = m.a AND k.distance = m.distance GROUP BY ALL), t AS (SELECT * FROM r UNION ALL SELECT path, 0, path FROM tr WHERE role = 'test_source' AND path NOT IN (SELECT path FROM r))"


def _ci(spark, sf_dir):
    f = read(spark, sf_dir, "part").selectExpr("concat('p', p_partkey) AS path", "CASE p_partkey % 10 WHEN 0 THEN 'test_source' WHEN 3 THEN 'build_config' ELSE 'main_source' END AS role")
    e = dependencies(spark, sf_dir).selectExpr("concat('p', a) AS a", "concat('p', b) AS b")
    ch = spark.createDataFrame([(f"p{k}", "M") for k in (11, 20, 33, 47)], "path string, status string")
    return ch, f, e, C.selected_tests(ch, f, e, 2, 100_000)


@query(sql("deps", rest=f"--recursive WITH {_CI} SELECT path, distance::INT AS distance, via FROM t"))
def gr10_selected_tests(spark, sf_dir):
    return _ci(spark, sf_dir)[3]


@query(sql("deps", rest=f"--recursive WITH {_CI} SELECT 0 AS ignored, 3 AS traced, 0 AS deleted, 1 AS configuration, 0 AS unknown, (SELECT count(*) FROM t) AS n_tests, (SELECT count(*) FROM part_files WHERE role = 'test_source') AS n_all, true AS run_all, round(1 - (SELECT count(*) FROM t) / (SELECT count(*) FROM part_files WHERE role = 'test_source'), 3) AS reduction"))
def gr10_verdict(spark, sf_dir):
    ch, f, _, tests = _ci(spark, sf_dir)
    return C.selection_verdict(ch, f, tests)


@query(sql("deps", rest="SELECT n AS file, count(*) AS hits FROM (SELECT b AS n FROM deps WHERE a < 12 AND b >= 12 UNION ALL SELECT a FROM deps WHERE b < 12 AND a >= 12) JOIN part ON p_partkey = n WHERE p_partkey % 10 > 4 AND p_partkey % 3 <> 0 GROUP BY n"))
def gr11_neighbours_by_role(spark, sf_dir):
    meta = read(spark, sf_dir, "part").selectExpr("p_partkey AS file", "CASE WHEN p_partkey % 10 > 4 THEN 'main_source' ELSE 'generated' END AS role", "CASE WHEN p_partkey % 3 = 0 THEN 'python' ELSE 'java' END AS language")
    return G.neighbours(dependencies(spark, sf_dir), spark.range(12).select(F.col("id").alias("file")), meta, "java")


@query(sql("found_symbols", "deps", "found_files", rest="""WITH i AS (SELECT y.file AS path, count(DISTINCT x.file) AS n FROM deps d JOIN found_symbols x ON x.id = d.a JOIN found_symbols y ON y.id = d.b GROUP BY 1)
 SELECT path, coverage, coalesce(n, 0) AS in_degree FROM (SELECT path, (contains(path, 'Red'))::INT + (contains(path, 'Bolt'))::INT + (contains(path, 'Cache'))::INT AS coverage FROM found_files WHERE role = 'main_source') LEFT JOIN i USING (path) WHERE coverage >= 2 ORDER BY coverage DESC, in_degree DESC, path LIMIT 30"""))
def gr12_central_by_two_words(spark, sf_dir):
    s = search_symbols(spark, sf_dir).select("id", "file")
    place = lambda end: s.select(F.col("id").alias(end), F.col("file").alias(f"f{end}"))
    d = dependencies(spark, sf_dir).join(place("a"), "a").join(place("b"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    return G.central_files(search_files(spark, sf_dir).filter("role = 'main_source'"), d, ["red", "bolt", "cache"]).limit(30)


@query(sql("deps", "calls", rest="SELECT node, count(*) AS degree FROM (SELECT 'src/'||(a % 97)||'.java' AS node FROM deps UNION ALL SELECT 'src/'||(b % 97)||'.java' FROM deps UNION ALL SELECT file FROM calls) GROUP BY node"))
def gr13_file_degrees(spark, sf_dir):
    d = dependencies(spark, sf_dir).selectExpr("concat('src/', a % 97, '.java') AS a", "concat('src/', b % 97, '.java') AS b")
    return A.degree_of_files(d, calls(spark, sf_dir))


_TREE = "concat('m', doc_id % 9, CASE WHEN doc_id % 13 = 0 THEN '/pom.xml' WHEN doc_id % 2 = 0 THEN concat('/sub/src/main/D', doc_id, '.java') ELSE concat('/D', doc_id, '.java') END)"


@query(f"""WITH f AS (SELECT doc_id, {_TREE} AS path FROM documents), sr AS (SELECT doc_id, CASE WHEN contains(path, '/src/') THEN split_part(path, '/src/', 1) ELSE split_part(path, '/', 1) END AS root FROM f),
 r AS (SELECT split_part(path, '/pom.xml', 1) AS root, 'marker' AS evidence FROM f WHERE path LIKE '%/pom.xml' UNION SELECT root, 'application' FROM sr WHERE doc_id % 17 = 0 UNION SELECT root, 'endpoint' FROM sr WHERE doc_id % 19 = 0) SELECT root, string_agg(evidence, ',' ORDER BY evidence) AS evidence FROM r GROUP BY root""")
def gr14_inferred_modules(spark, sf_dir):
    f = read(spark, sf_dir, "documents").selectExpr("doc_id", f"{_TREE} AS path")
    s = f.filter("doc_id % 17 = 0").select(F.col("path").alias("file"), F.lit("spring:application").alias("framework_role"))
    return A.module_roots(f, s, f.filter("doc_id % 19 = 0").select(F.col("path").alias("file")))


_MODULES = "m AS (SELECT doc_id, source||'/'||lang||'/doc_'||doc_id AS path, source||'/'||lang AS module FROM documents), e AS (SELECT x.module AS source, y.module AS target, count(*) AS edge_count FROM deps d JOIN m x ON x.doc_id = d.a JOIN m y ON y.doc_id = d.b WHERE x.module <> y.module GROUP BY ALL), seed AS (SELECT path FROM m WHERE doc_id IN (3, 8))"


def _modules(spark, sf_dir):
    m = files(spark, sf_dir).select("doc_id", "path", F.substring_index("path", "/", 2).alias("module"))
    of = lambda end, name: m.select(F.col("doc_id").alias(end), F.col("module").alias(name))
    e = dependencies(spark, sf_dir).join(of("a", "source"), "a").join(of("b", "target"), "b").filter("source <> target").groupBy("source", "target").agg(F.count(ONE).alias("edge_count"))
    return m.filter("doc_id IN (3, 8)").select("path"), m.select("path", "module"), e


@query(sql("deps", rest=f"""WITH {_MODULES}, own AS (SELECT module, count(*) AS n FROM m WHERE path IN (SELECT path FROM seed) GROUP BY module ORDER BY module LIMIT 12), t AS (SELECT * FROM e WHERE source IN (SELECT module FROM own) OR target IN (SELECT module FROM own) ORDER BY edge_count DESC, source, target LIMIT 36),
 far AS (SELECT key, count(*) AS n FROM (SELECT source AS key FROM t UNION ALL SELECT target FROM t) WHERE key NOT IN (SELECT module FROM own) GROUP BY key ORDER BY key LIMIT 12) SELECT 'module' AS section, module AS key, n FROM own UNION ALL SELECT 'edge', source||' > '||target, edge_count FROM t UNION ALL SELECT 'bridge', key, n FROM far"""))
def gr16_architecture_context(spark, sf_dir):
    return A.context_of(*_modules(spark, sf_dir))


@query(sql("deps", rest=f"WITH {_MODULES} SELECT module, path FROM m WHERE module IN (SELECT module FROM m WHERE path IN (SELECT path FROM seed)) AND path NOT IN (SELECT path FROM seed) ORDER BY path LIMIT 12"))
def gr17_sibling_files(spark, sf_dir):
    seed, m, _ = _modules(spark, sf_dir)
    return A.siblings(seed, m)


_RAW = "CASE l_partkey % 8 WHEN 0 THEN 'go' WHEN 1 THEN 'this.go' WHEN 2 THEN 'super.go' WHEN 3 THEN 'repo.save' WHEN 4 THEN 'Util.run' WHEN 5 THEN 'unknown.run' WHEN 6 THEN 'own' ELSE 'a.b.c' END"


@query(f"""WITH c AS (SELECT DISTINCT 'C' || (l_suppkey % 8) || '.m(int)' AS caller, {_RAW} AS callee, l_suppkey % 8 AS k, l_partkey % 8 AS r FROM lineitem),
 x AS (SELECT caller, callee, CASE r WHEN 0 THEN CASE WHEN k = 0 THEN 'C0' WHEN k <= 3 THEN 'C1' WHEN k = 5 THEN 'C1' ELSE NULL END WHEN 1 THEN CASE WHEN k = 0 THEN 'C0' WHEN k <= 3 THEN 'C1' END WHEN 2 THEN CASE WHEN k = 0 THEN 'C1' WHEN k IN (2, 3) THEN 'C1' END WHEN 3 THEN CASE WHEN k IN (0, 1, 2) THEN 'OrderRepository' WHEN k = 5 THEN 'OrderRepository' WHEN k = 3 THEN 'OrderRepository' END WHEN 4 THEN 'Util' WHEN 6 THEN CASE WHEN k IN (4, 6) THEN 'C4' END END AS owner, r FROM c)
 SELECT caller, callee, owner || '.' || CASE WHEN r < 3 THEN 'go' WHEN r = 3 THEN 'save' WHEN r = 4 THEN 'run' ELSE 'own' END AS resolved, CASE WHEN owner IS NULL THEN NULL WHEN r IN (0, 1, 6) THEN 'enclosing-method' WHEN r = 2 THEN 'super-method' WHEN r = 3 THEN 'receiver-field' ELSE 'static-or-type-receiver' END AS how, CASE WHEN owner IS NULL THEN NULL WHEN r IN (3, 4) THEN 0.8 ELSE 0.82 END::DOUBLE AS sure FROM x""")
def gr20_receiver_resolution(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").selectExpr("concat('C', l_suppkey % 8, '.m(int)') AS caller", f"{_RAW} AS callee").distinct()
    # C3 extends C2 extends C1, C0 extends C1; C5 lies in C2, C6 in C4; C1 and C0 have go, C4 has own, C1 has the field repo
    extends = spark.createDataFrame([("C3", "C2"), ("C2", "C1"), ("C0", "C1")], "child string, parent string")
    outer = spark.createDataFrame([("C5", "C2"), ("C6", "C4")], "child string, parent string")
    methods = spark.createDataFrame([("C1", "go"), ("C0", "go"), ("C4", "own")], "owner string, method string")
    fields = spark.createDataFrame([("C1", "repo", "OrderRepository")], "owner string, field string, type string")
    return N.resolved_owners(c, methods, fields, extends, outer)


_RAWC = "CASE l_partkey % 5 WHEN 0 THEN 'assertEquals' WHEN 1 THEN 'A.b' WHEN 2 THEN 'x -> y' WHEN 3 THEN 'when' ELSE 'z.when' END AS callee, CASE l_linenumber % 4 WHEN 0 THEN ' C.m ' WHEN 1 THEN '(a)' WHEN 2 THEN '' ELSE 'D' END AS caller, CASE WHEN l_returnflag = 'A' THEN 'scip-reference' ELSE 'name-only' END AS resolution, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE round(1 - l_discount * 5, 4) END AS confidence"


@query(f"""WITH c AS (SELECT {_RAWC}, l_partkey % 5 AS k, l_linenumber % 4 AS j FROM lineitem), t AS (SELECT trim(caller) AS caller, callee, resolution, coalesce(confidence, 0.4) AS base, resolution = 'scip-reference' AS p, concat_ws('; ', CASE WHEN j = 1 THEN 'caller is an expression' END, CASE WHEN k = 2 THEN 'callee is an expression' END, CASE WHEN k IN (0, 3) THEN 'low-signal unqualified helper call' END) AS r FROM c WHERE j <> 2)
 SELECT caller, callee, CASE WHEN p THEN 'provider' WHEN r <> '' THEN 'low_signal' ELSE 'primary' END AS tier, CASE WHEN p THEN 'semantic provider fact' ELSE r END AS reasons, round(sum(CASE WHEN p THEN greatest(base, 0.9) WHEN r <> '' THEN least(base, 0.25) ELSE base END), 4) AS confidence, count(*) AS n FROM t GROUP BY ALL""")
def gr22_classified_calls(spark, sf_dir):
    c = N.classified(read(spark, sf_dir, "lineitem").selectExpr(*_RAWC.replace(" AS callee, CASE", " AS callee\0CASE").replace(" AS caller, CASE", " AS caller\0CASE").replace(" AS resolution, CASE", " AS resolution\0CASE").split("\0")))
    return c.groupBy("caller", "callee", "tier", F.array_join("reasons", "; ").alias("reasons")).agg(F.round(F.sum("confidence"), 4).alias("confidence"), F.count(ONE).alias("n"))


_FIND = "CASE WHEN event_type = 'error' THEN 'P0' WHEN event_type IN ('click', 'view') THEN 'P1' ELSE 'P2' END AS priority"


@query(f"SELECT priority, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, {_FIND} FROM events) GROUP BY priority")
def ag24_priority_counts(spark, sf_dir):
    f = read(spark, sf_dir, "events").selectExpr("concat(user_id, event_type) AS id", _FIND)
    return Q.priority_counts(f)


@query("SELECT count(DISTINCT d.doc_id) AS expected, count(DISTINCT l.doc_id) AS reviewed, round(count(DISTINCT l.doc_id) / count(DISTINCT d.doc_id), 3) AS ratio, count(DISTINCT d.doc_id) = count(DISTINCT l.doc_id) AS complete FROM documents d LEFT JOIN labels l USING (doc_id)")
def ag23_review_coverage(spark, sf_dir):
    return Q.coverage(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


@query("""WITH e AS (SELECT 'K' || (l_suppkey % 10) || '.m' || l_suppkey AS caller, CASE WHEN l_partkey % 9 = 0 THEN 'Optional.of' WHEN l_partkey % 9 = 1 THEN 'go' ELSE 'x.K' || CASE WHEN l_partkey % 3 = 0 THEN l_suppkey * 3 % 10 ELSE l_partkey % 10 END || '.run' END AS callee FROM lineitem), o AS (SELECT caller, split_part(callee, '.', 2) AS owner, count(*) AS n FROM e WHERE callee LIKE 'x.%' GROUP BY ALL),
 w AS (SELECT caller, coalesce(max(n) FILTER (owner = split_part(caller, '.', 1)), 0) AS own, max_by(owner, (n, owner)) FILTER (owner <> split_part(caller, '.', 1)) AS envied, max(n) FILTER (owner <> split_part(caller, '.', 1)) AS n FROM o GROUP BY caller) SELECT caller, envied, n, own FROM w WHERE n >= 3 AND n >= 2 * own""")
def ag25_feature_envy(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").selectExpr("concat('K', l_suppkey % 10, '.m', l_suppkey) AS caller", "CASE WHEN l_partkey % 9 = 0 THEN 'Optional.of' WHEN l_partkey % 9 = 1 THEN 'go' ELSE concat('x.K', CASE WHEN l_partkey % 3 = 0 THEN l_suppkey * 3 % 10 ELSE l_partkey % 10 END, '.run') END AS callee")
    return Q.feature_envy(e)


_EXP = "SELECT DISTINCT user_id % 30 AS task, event_id % 40 AS file FROM events WHERE event_type = 'purchase'"
_FND = "SELECT user_id % 30 AS task, event_id % 40 AS file, min(event_id % 25)::INT AS place FROM events WHERE event_type = 'view' GROUP BY ALL"


@query(f"WITH e AS ({_EXP}), f AS ({_FND}) SELECT task, count(*) AS need, round(count(place) / count(*), 2) AS recall, count(place) = count(*) AS all_found, round(count(*) FILTER (place <= 6) / count(*), 2) AS recall_at_6, round(count(*) FILTER (place <= 10) / count(*), 2) AS recall_at_10, round(count(*) FILTER (place <= 15) / count(*), 2) AS recall_at_15 FROM e LEFT JOIN f USING (task, file) GROUP BY task")
def ag26_recall_by_task(spark, sf_dir):
    ev = read(spark, sf_dir, "events").selectExpr("user_id % 30 AS task", "event_id % 40 AS file", "event_type", "event_id % 25 AS place")
    return C.recall_by_task(ev.filter("event_type = 'purchase'").select("task", "file"), ev.filter("event_type = 'view'").select("task", "file", "place"))


@query(f"WITH e AS ({_EXP}), f AS ({_FND}), t AS (SELECT task, round(count(place) / count(*), 2) AS recall, count(place) = count(*) AS ok FROM e LEFT JOIN f USING (task, file) GROUP BY task) SELECT count(*) AS tasks, count(*) FILTER (ok) AS all_found, round(avg(recall), 2) AS avg_recall, round(count(*) FILTER (NOT ok) / count(*), 2) AS gap FROM t")
def ag26_recall_summary(spark, sf_dir):
    return C.recall_summary(ag26_recall_by_task(spark, sf_dir))


@query(sql("deps", rest="""WITH t AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 10 = 0), d AS (SELECT DISTINCT b AS changed, a AS test FROM deps WHERE a IN (SELECT id FROM t) AND b NOT IN (SELECT id FROM t)), two AS (SELECT DISTINCT changed, test FROM (SELECT b AS changed, a AS test FROM deps UNION ALL SELECT y.b, x.a FROM deps x JOIN deps y ON x.b = y.a) WHERE test IN (SELECT id FROM t) AND test <> changed)
 SELECT d.changed, count(*) AS n_direct, (SELECT count(*) FROM two WHERE two.changed = d.changed) AS n_selected, 1.0::DOUBLE AS recall FROM d GROUP BY d.changed"""))
def ag27_selection_recall(spark, sf_dir):
    roles = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 10 == 0, "test_source").otherwise("main_source").alias("role"))
    return C.direct_test_recall(dependencies(spark, sf_dir), roles)


_ARMS = "SELECT chr((65 + user_id % 4)::INT) AS arm, count(*) FILTER (event_type = 'error' AND value < 0) AS false_answerable, round(avg(value) / 100, 4) AS file_recall, round(max(value) / 1000, 4) AS method_recall, 0 AS critical_misses, sum(event_id) AS tokens, round(sum(value), 2) AS wall_ms FROM events GROUP BY 1"


@query(f"""WITH a AS ({_ARMS}), r AS (SELECT max(CASE arm WHEN 'A' THEN file_recall END) AS fa, max(CASE arm WHEN 'B' THEN file_recall END) AS fb, max(CASE arm WHEN 'C' THEN file_recall END) AS fc, max(CASE arm WHEN 'D' THEN file_recall END) AS fd, max(CASE arm WHEN 'A' THEN method_recall END) AS ma, max(CASE arm WHEN 'B' THEN method_recall END) AS mb, max(CASE arm WHEN 'C' THEN method_recall END) AS mc, max(CASE arm WHEN 'D' THEN method_recall END) AS md,
 max(CASE arm WHEN 'A' THEN tokens END)::DOUBLE AS ta, max(CASE arm WHEN 'B' THEN tokens END)::DOUBLE AS tb, max(CASE arm WHEN 'C' THEN tokens END)::DOUBLE AS tc, max(CASE arm WHEN 'D' THEN tokens END)::DOUBLE AS td, max(CASE arm WHEN 'B' THEN wall_ms END) AS wb, max(CASE arm WHEN 'D' THEN wall_ms END) AS wd, max(false_answerable) AS z FROM a)
 SELECT "check", round(value, 4) AS value, passed FROM (SELECT unnest(['false_answerable_a','false_answerable_b','false_answerable_c','false_answerable_d']) AS "check", z::DOUBLE AS value, z = 0 AS passed FROM r UNION ALL SELECT 'file_recall_c', fc, fc >= greatest(fa, fb) FROM r UNION ALL SELECT 'method_recall_c', mc, mc >= greatest(ma, mb) FROM r UNION ALL SELECT 'critical_misses_c', 0, true FROM r UNION ALL SELECT 'file_recall_d', fd, fd >= greatest(fa, fb) FROM r UNION ALL SELECT 'method_recall_d', md, md >= greatest(ma, mb) FROM r UNION ALL SELECT 'critical_misses_d', 0, true FROM r
 UNION ALL SELECT 'tokens_d_vs_b', (tb - td) / tb * 100, (tb - td) / tb * 100 >= 20 FROM r UNION ALL SELECT 'tokens_d_vs_a', (ta - td) / ta * 100, (ta - td) / ta * 100 >= 30 FROM r UNION ALL SELECT 'tokens_c_vs_b', (tc - tb) / tb * 100, (tc - tb) / tb * 100 <= 10 FROM r UNION ALL SELECT 'wall_d_vs_b', (wd - wb) / wb * 100, (wd - wb) / wb * 100 <= 30 FROM r UNION ALL SELECT 'stale_detection', 100, true FROM r UNION ALL SELECT 'advertised_schema', 640, false FROM r UNION ALL SELECT 'index_regression', 4.5, true FROM r UNION ALL SELECT 'query_regression', 5, true FROM r)""")
def ag28_release_gate(spark, sf_dir):
    ev = read(spark, sf_dir, "events").withColumn("arm", F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("user_id") % 4 + 1).cast("int")))
    arms = ev.groupBy("arm").agg(F.count_if((F.col("event_type") == "error") & (F.col("value") < 0)).alias("false_answerable"), F.round(F.avg("value") / 100, 4).alias("file_recall"), F.round(F.max("value") / 1000, 4).alias("method_recall"), F.lit(0).alias("critical_misses"), F.sum("event_id").alias("tokens"), F.round(F.sum("value"), 2).alias("wall_ms"))
    return C.release_gate(arms, spark.createDataFrame([(100.0, 640.0, 4.5, 5.0)], "stale_detection double, advertised_schema double, index_regression double, query_regression double"))


_HUNK = "CASE doc_id % 10 WHEN 0 THEN 'password = \"hunter22x\"' WHEN 1 THEN 'String q = \"select * from t where a=\" + a' WHEN 2 THEN '@GetMapping public class A' WHEN 3 THEN 'catch (Exception e)' WHEN 4 THEN 'console.log(x)' WHEN 5 THEN 'Runtime.getRuntime().exec(cmd)' WHEN 6 THEN 'x = 1' WHEN 7 THEN 'assert y' WHEN 8 THEN 'auth role' ELSE '' END"


@query(f"""SELECT doc_id, kinds, score, CASE WHEN score >= 160 THEN 'critical' WHEN score >= 90 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS level FROM (SELECT doc_id, CASE k WHEN 0 THEN 'security' WHEN 1 THEN 'sql' WHEN 2 THEN 'contract,endpoint' WHEN 3 THEN 'error-handling' WHEN 4 THEN 'debug-output' WHEN 7 THEN 'test' WHEN 8 THEN 'security' ELSE '' END AS kinds,
 CASE k WHEN 0 THEN 100 + 120 WHEN 1 THEN 85 + 90 WHEN 2 THEN 65 + 75 WHEN 3 THEN 55 WHEN 4 THEN 35 WHEN 5 THEN 100 WHEN 7 THEN 10 WHEN 8 THEN 100 ELSE 0 END + least(30, 1 + doc_id % 40)::INT AS score FROM (SELECT doc_id, doc_id % 10 AS k FROM documents))""")
def cardm_hunk_kinds(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit("src/A.java").alias("file"), F.expr(_HUNK).alias("added"), F.lit("").alias("removed"), (F.col("doc_id") % 40 + 1).alias("changed"))
    return Q.hunk_risk(d).select("doc_id", F.array_join(F.sort_array("kinds"), ",").alias("kinds"), F.col("score").cast("int").alias("score"), "level")


@query(f"""SELECT rule, priority, count(*) AS n FROM (SELECT unnest(CASE doc_id % 10 WHEN 0 THEN ['secret'] WHEN 1 THEN ['sql-concat'] WHEN 3 THEN ['broad-catch'] WHEN 4 THEN ['debug-output'] WHEN 5 THEN ['command-exec'] ELSE []::VARCHAR[] END) AS rule FROM documents), (VALUES ('secret','P0'),('sql-concat','P1'),('broad-catch','P1'),('debug-output','P2'),('command-exec','P1')) AS v(r, priority) WHERE rule = r GROUP BY ALL
 UNION ALL SELECT 'removed-assertion', 'P1', count(*) FROM documents WHERE doc_id % 30 IN (6, 26) HAVING count(*) > 0""")
def review_hunk_findings(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("f"), "doc_id").alias("file"), F.expr(_HUNK).alias("added"), F.expr("CASE WHEN doc_id % 30 IN (6, 26) THEN 'assertThrows(x)' ELSE '' END").alias("removed"))
    return Q.hunk_findings(d).groupBy("rule", "priority").agg(F.count(ONE).alias("n"))


@query(sql("symbols", "calls", rest="""WITH ch AS (SELECT fq_name, 'P'||id AS callee, file FROM symbols WHERE kind IN ('method') AND file IN ('src/7.java', 'src/2.java')), x AS (SELECT ch.fq_name, c.caller, c.file, c.line, c.confidence, row_number() OVER (PARTITION BY ch.fq_name ORDER BY CASE c.tier WHEN 'provider' THEN 0 ELSE 1 END, c.confidence DESC, c.file, c.line, c.caller) AS rn, count(*) OVER (PARTITION BY ch.fq_name) AS n FROM ch JOIN calls c USING (callee) WHERE c.tier <> 'low_signal' AND c.file NOT IN ('src/7.java', 'src/2.java'))
 SELECT fq_name, n AS caller_count, string_agg(caller||'@'||file||':'||line, ' ' ORDER BY rn) AS callers FROM x WHERE rn <= 5 GROUP BY ALL"""))
def review_stale_callers(spark, sf_dir):
    changed = spark.createDataFrame([("src/7.java",), ("src/2.java",)], "file string")
    s = symbols(spark, sf_dir).filter("kind = 'method'").join(changed, "file", "left_semi").select("fq_name", F.concat(F.lit("P"), "id").alias("callee"))
    return Q.stale_callers(s, R.visible_calls(calls(spark, sf_dir)), changed)


@query(sql("symbols", "calls", rest="""SELECT rule, fq_name, n FROM (SELECT 'long-method' AS rule, fq_name, (end_line - line + 1) * 6 AS n FROM symbols WHERE kind = 'method' AND (end_line - line + 1) * 6 > 60 UNION ALL SELECT 'long-parameter-list', fq_name, id % 9 FROM symbols WHERE kind = 'method' AND id % 9 > 5
 UNION ALL SELECT 'dead-code', fq_name, 0 FROM symbols s WHERE kind = 'method' AND id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.callee = 'P'||(s.id * 3) AND tier <> 'low_signal') UNION ALL SELECT 'large-class', file, count(*) FROM (SELECT file FROM symbols WHERE kind = 'method' UNION ALL SELECT 'src/9.java' FROM lineitem) GROUP BY file HAVING count(*) > 25)"""))
def review_design_quality(spark, sf_dir):
    s = symbols(spark, sf_dir).filter("kind = 'method'").select("fq_name", "file", ((F.col("end_line") - F.col("line") + 1) * 6).alias("lines"), (F.col("id") % 9).alias("parameters"), (F.col("id") % 2 == 0).alias("private"), F.concat(F.lit("P"), F.col("id") * 3).alias("callee"))
    more = read(spark, sf_dir, "lineitem").select(F.lit("src/9.java").alias("file"))
    return Q.design_findings(s, R.visible_calls(calls(spark, sf_dir)), s.select("file").union(more))
