"""Queries of visibility, projections, joins, aggregates and set operations that other modules leave out, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import architecture as A
from ..operators import filters as V
from ..operators import relational as R
from ..operators import resolution as N
from ..operators import search as S
from ..operators.tables import calls, dependencies, endpoints, file_endpoints, files, query_log, read, search_files, search_symbols, sql, symbols
from .registry import query

ONE = "*"  # what a count counts


@query(sql("found_symbols", rest="SELECT id, name, role FROM found_symbols WHERE role NOT IN ('test_source', 'generated', 'mock_source') AND NOT synthetic AND framework_role = 'spring:service' AND list_has_any(annotations, ['Cacheable', 'Transactional'])"))
def flt01_visible_symbols(spark, sf_dir):
    return V.visible_symbols(search_symbols(spark, sf_dir), "small widget", language="java", framework_role="spring:service", annotation="able").union(
        V.visible_symbols(search_symbols(spark, sf_dir), "small widget", framework_role="spring:service", annotation="TRANSACTIONAL")).select("id", "name", "role")


@query(sql("found_symbols", rest="SELECT id, name, role FROM found_symbols WHERE role <> 'generated' AND NOT synthetic"))
def flt01_intent_shows_tests(spark, sf_dir):
    return V.visible_symbols(search_symbols(spark, sf_dir), "mock widgetTests").select("id", "name", "role")


_REFS = "SELECT 'definition' AS kind, fq_name AS name, role, NULL::VARCHAR AS tier, NULL::DOUBLE AS confidence, synthetic FROM found_symbols UNION ALL SELECT 'call', callee, 'main_source', tier, confidence, NULL FROM calls UNION ALL SELECT 'field_usage', callee, 'test_source', tier, confidence, NULL FROM calls WHERE line = 2 UNION ALL SELECT 'field_usage', callee, 'main_source', tier, confidence, NULL FROM calls WHERE line = 3 UNION ALL SELECT 'import', 'P'||b, 'main_source', NULL, NULL, NULL FROM deps"


@query(sql("found_symbols", "calls", "deps", rest=f"WITH r AS ({_REFS}) SELECT kind, tier, count(*) AS n, count(DISTINCT name) AS n_names FROM r WHERE role NOT IN ('test_source','generated','mock_source') AND CASE kind WHEN 'definition' THEN NOT synthetic WHEN 'call' THEN tier <> 'low_signal' WHEN 'field_usage' THEN confidence >= 0.5 ELSE true END GROUP BY ALL"))
def flt03_visible_references(spark, sf_dir):
    c = calls(spark, sf_dir)
    usage = c.select(F.lit("field_usage").alias("kind"), F.col("callee").alias("name"), F.when(F.col("line") == 2, "test_source").otherwise("main_source").alias("role"), "tier", "confidence", "line").filter("line IN (2, 3)").drop("line")
    refs = search_symbols(spark, sf_dir).select(F.lit("definition").alias("kind"), F.col("fq_name").alias("name"), "role", "synthetic")
    refs = refs.unionByName(c.select(F.lit("call").alias("kind"), F.col("callee").alias("name"), F.lit("main_source").alias("role"), "tier", "confidence"), True).unionByName(usage, True)
    refs = refs.unionByName(dependencies(spark, sf_dir).select(F.lit("import").alias("kind"), F.concat(F.lit("P"), "b").alias("name"), F.lit("main_source").alias("role")), True)
    return V.visible_references(refs, "widget").groupBy("kind", "tier").agg(F.count(ONE).alias("n"), F.countDistinct("name").alias("n_names"))


_ASK = "concat(p_name, CASE p_partkey % 8 WHEN 0 THEN ' testWidget' WHEN 1 THEN ' latest' WHEN 2 THEN ' generated getter' WHEN 3 THEN ' stubs' WHEN 4 THEN ' gen' WHEN 5 THEN ' Lombok' WHEN 6 THEN ' Should work' ELSE '' END)"


@query("SELECT p_partkey AS id, p_partkey % 8 IN (0, 6) AS tests, p_partkey % 8 IN (2, 4) AS generated, p_partkey % 8 IN (0, 3, 6) AS fixtures, p_partkey % 8 IN (2, 5) AS synthetic FROM part")
def flt04_intents(spark, sf_dir):
    q = F.expr(_ASK)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(c.alias(k) for k, c in V.shown(q).items())).select("id", "tests", "generated", "fixtures", "synthetic")


@query(sql("endpoints", rest="SELECT id, method, path FROM endpoints WHERE method = 'GET' ORDER BY path, id LIMIT 25 OFFSET 5"))
def flt08_optional_parameters(spark, sf_dir):
    e = V.with_parameters(endpoints(spark, sf_dir), method="GET", path=None, id="ALL")
    return R.page(e, [F.col("path"), F.col("id")], 5, 25).select("id", "method", "path")


_SRC = "CASE l_partkey % 5 WHEN 0 THEN concat('java.util.C', l_partkey % 50) WHEN 1 THEN concat('com.acme.P', l_partkey) WHEN 2 THEN concat('lombok.T', l_partkey % 9) WHEN 3 THEN concat('javax_own.T', l_partkey % 40) ELSE concat('org.junit.T', l_partkey % 20) END"


@query(f"SELECT source, count(*) AS n FROM (SELECT {_SRC} AS source FROM lineitem) WHERE starts_with(source, 'com.') OR starts_with(source, 'javax_own.') GROUP BY source")
def flt10_external_imports(spark, sf_dir):
    i = read(spark, sf_dir, "lineitem").selectExpr(f"{_SRC} AS source")
    return i.filter(~V.common_external(F.col("source"))).groupBy("source").agg(F.count(ONE).alias("n"))


@query(f"WITH i AS (SELECT {_SRC} AS source FROM lineitem), n AS (SELECT source, count(*) AS n FROM i WHERE starts_with(source, 'com.') OR starts_with(source, 'javax_own.') GROUP BY source ORDER BY n DESC, source LIMIT 200) SELECT source, n FROM n WHERE split_part(source, '.', -1) NOT IN (SELECT CASE p_partkey % 3 WHEN 0 THEN 'P' ELSE 'Q' END || p_partkey FROM part WHERE p_partkey % 5 IN (0, 1, 4)) ORDER BY n DESC, source LIMIT 20")
def ag03_unresolved_imports(spark, sf_dir):
    i = read(spark, sf_dir, "lineitem").selectExpr(f"{_SRC} AS source")
    s = symbols(spark, sf_dir).select(F.concat(F.lit("zz."), "id").alias("fq_name"), F.expr("concat(CASE id % 3 WHEN 0 THEN 'P' ELSE 'Q' END, id)").alias("name"), "kind")
    return N.unresolved_imports(i, s, V.common_external(F.col("source")))


_CALLEE = "CASE l_partkey % 7 WHEN 0 THEN 'java.util.Thing.add' WHEN 1 THEN 'Optional.of' WHEN 2 THEN 'OrderService.run' WHEN 3 THEN 'run' WHEN 4 THEN 'x.String.valueOf' WHEN 5 THEN 'a.javax.z.Q.go' ELSE 'StringUtil.trim' END"


@query(f"SELECT callee, count(*) AS n, callee NOT IN ('OrderService.run', 'run', 'StringUtil.trim') AS library FROM (SELECT {_CALLEE} AS callee FROM lineitem) GROUP BY callee")
def flt11_library_calls(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").selectExpr(f"{_CALLEE} AS callee")
    return c.groupBy("callee").agg(F.count(ONE).alias("n")).withColumn("library", V.library_call(F.col("callee")))


@query(sql("files", rest="SELECT path, role FROM files WHERE role NOT IN ('test_source', 'mock_source')"))
def flt12_graph_roles(spark, sf_dir):
    return V.graph_roles(files(spark, sf_dir), generated=True).select("path", "role")


_PATH = "concat(source, '/', lang, CASE doc_id % 12 WHEN 0 THEN '/pom.xml' WHEN 1 THEN '/README.MD' WHEN 2 THEN '/src/main/resources/a.dat' WHEN 3 THEN '/Dockerfile.dev' WHEN 4 THEN '/LICENSE' WHEN 5 THEN '/.husky/pre' WHEN 6 THEN '/tsconfig.base.json' WHEN 7 THEN '/docker-compose.yml' WHEN 8 THEN '/schema.sql' WHEN 9 THEN '/a.md.java' WHEN 10 THEN '/package.json' ELSE '/Main.java' END)"


@query(f"SELECT doc_id, path, k IN (1, 4, 5) AS ignored, k IN (0, 2, 3, 6, 7, 8, 10) AS runs_all FROM (SELECT doc_id, {_PATH} AS path, doc_id % 12 AS k FROM documents)")
def flt13_changed_paths(spark, sf_dir):
    d = read(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PATH} AS path")
    return d.select("doc_id", "path", V.ignorable(F.col("path")).alias("ignored"), V.runs_all(F.col("path")).alias("runs_all"))


@query(f"SELECT path, count(*) AS blocks, sum(n_chars) AS chars FROM (SELECT {_PATH} AS path, n_chars, doc_id % 12 AS k FROM documents) WHERE k NOT IN (1, 4, 5) GROUP BY path")
def flt14_diff_blocks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").selectExpr(f"{_PATH} AS path", "n_chars")
    return d.filter(~V.ignorable(F.col("path"))).groupBy("path").agg(F.count(ONE).alias("blocks"), F.sum("n_chars").alias("chars"))


_JSON = "CASE p_partkey % 4 WHEN 0 THEN '[\"int\",\"String\"]' WHEN 1 THEN '[]' WHEN 2 THEN 'broken[' ELSE NULL END"


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 2 ELSE 0 END AS n_parameters, CASE p_partkey % 4 WHEN 0 THEN 'int,String' ELSE '' END AS parameters, CASE p_partkey % 4 WHEN 1 THEN 'true' END AS synthetic FROM part")
def prj01_symbol_view(spark, sf_dir):
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_JSON} AS parameter_types_json", "'[\"A\"' AS annotations_json", "CASE p_partkey % 4 WHEN 1 THEN '{\"synthetic\":\"true\"}' WHEN 2 THEN '{' END AS framework_meta_json")
    v = V.symbol_view(rows)
    return v.select("id", F.size("parameter_types").alias("n_parameters"), F.array_join("parameter_types", ",").alias("parameters"), F.col("framework_meta")["synthetic"].alias("synthetic"))


@query("SELECT doc_id AS line, source AS file, CASE WHEN length(text) > 160 THEN substr(text, 1, 157) || '...' ELSE text END AS context FROM documents")
def prj02_slim_references(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), F.col("source").alias("file"), F.col("text").alias("context"), "n_chars", "lang")
    return V.slim_references(d)


@query(sql("calls", rest="SELECT 'P7' AS callee, EXISTS (SELECT 1 FROM calls WHERE callee = 'P7') AS found UNION ALL SELECT 'nowhere', EXISTS (SELECT 1 FROM calls WHERE callee = 'nowhere')"))
def prj03_exists(spark, sf_dir):
    c = calls(spark, sf_dir)
    return spark.createDataFrame([(x, V.exists(c.filter(F.col("callee") == x))) for x in ("P7", "nowhere")], "callee string, found boolean")


@query("SELECT o.o_orderkey AS snapshot, c.c_custkey AS workspace, c.c_mktsegment AS label, o.o_orderstatus AS status FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderkey = (SELECT max(x.o_orderkey) FROM orders x WHERE x.o_custkey = c.c_custkey)")
def jn01_current_snapshots(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct(F.col("o_orderkey").alias("snapshot"), F.col("o_orderstatus").alias("status"))).alias("s"))
    return o.join(read(spark, sf_dir, "customer"), o.o_custkey == F.col("c_custkey")).select("s.snapshot", F.col("c_custkey").alias("workspace"), F.col("c_mktsegment").alias("label"), "s.status")


@query(sql("found_symbols", "deps", "endpoints", "found_files", "found_endpoints", rest="SELECT DISTINCT f.path, f.role FROM found_files f JOIN found_symbols s ON s.file = f.path WHERE contains(lower(s.name), 'bolt') UNION SELECT DISTINCT f.path, f.role FROM found_files f JOIN found_endpoints e ON e.file = f.path WHERE e.method = 'PUT'"))
def jn02_candidate_files(spark, sf_dir):
    f = search_files(spark, sf_dir).select("path", "role")
    hit = search_symbols(spark, sf_dir).filter(R.contains_text("name", "bolt")).select(F.col("file").alias("path")).union(file_endpoints(spark, sf_dir).filter("method = 'PUT'").select(F.col("file").alias("path")))
    return f.join(hit, "path", "left_semi")


@query(sql("found_symbols", "deps", "calls", "endpoints", "found_files", "found_endpoints", rest="""SELECT path, n_in, n_out, n_calls, n_symbols, n_endpoints, 3*n_in + 2*n_out + 2*n_calls + 25*n_endpoints + n_symbols AS weight, 3*n_in + 2*n_out + 2*n_calls + 25*n_endpoints + least(n_symbols, 100) AS risk,
 CASE WHEN 3*n_in + 2*n_out + 2*n_calls + 25*n_endpoints + least(n_symbols, 100) >= 80 THEN 'high' WHEN 3*n_in + 2*n_out + 2*n_calls + 25*n_endpoints + least(n_symbols, 100) >= 25 THEN 'medium' ELSE 'low' END AS level
 FROM (SELECT f.path, coalesce(i.n,0) AS n_in, coalesce(o.n,0) AS n_out, coalesce(c.n,0) AS n_calls, coalesce(s.n,0) AS n_symbols, coalesce(e.n,0) AS n_endpoints FROM found_files f
 LEFT JOIN (SELECT y.file AS path, count(*) AS n FROM deps d JOIN found_symbols y ON y.id = d.b GROUP BY 1) i USING (path) LEFT JOIN (SELECT y.file AS path, count(*) AS n FROM deps d JOIN found_symbols y ON y.id = d.a GROUP BY 1) o USING (path)
 LEFT JOIN (SELECT y.file AS path, count(*) AS n FROM calls k JOIN found_symbols y ON 'P'||y.id = k.callee WHERE k.tier <> 'low_signal' GROUP BY 1) c USING (path) LEFT JOIN (SELECT file AS path, count(*) AS n FROM found_symbols GROUP BY 1) s USING (path) LEFT JOIN (SELECT file AS path, count(*) AS n FROM found_endpoints GROUP BY 1) e USING (path))
 ORDER BY weight DESC, path LIMIT 500"""))
def jn03_file_hotspots(spark, sf_dir):
    s = search_symbols(spark, sf_dir).select("id", "file")
    place = lambda end: s.select(F.col("id").alias(end), F.col("file").alias(f"f{end}"))
    d = dependencies(spark, sf_dir).join(place("a"), "a").join(place("b"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    c = R.visible_calls(calls(spark, sf_dir)).join(s.select(F.concat(F.lit("P"), "id").alias("callee"), F.col("file").alias("f")), "callee").select(F.col("f").alias("file"))
    h = A.hotspots(search_files(spark, sf_dir), d, c, s, file_endpoints(spark, sf_dir).select("file"))
    return h.orderBy(F.desc("weight"), "path").limit(500)


@query(sql("symbols", "calls", rest="""SELECT u.access, u.from_file, s.file AS to_file, sum(u.n) AS edge_count, max(u.best) AS confidence FROM (SELECT l_linestatus AS access, 'src/'||(l_orderkey % 97)||'.java' AS from_file, 'P'||l_partkey AS callee, count(*) AS n, max(round(1 - l_discount * 5, 4)) AS best FROM lineitem GROUP BY ALL) u
 JOIN (SELECT 'P'||id AS callee, min(file) AS file FROM symbols WHERE kind = 'field' GROUP BY 1) s USING (callee) WHERE s.file <> u.from_file GROUP BY ALL"""))
def jn05_field_edges(spark, sf_dir):
    u = read(spark, sf_dir, "lineitem").selectExpr("l_linestatus AS access", "concat('src/', l_orderkey % 97, '.java') AS from_file", "concat('P', l_partkey) AS callee", "round(1 - l_discount * 5, 4) AS confidence")
    u = u.groupBy("access", "from_file", "callee").agg(F.count(ONE).alias("n"), F.max("confidence").alias("best"))
    s = symbols(spark, sf_dir).filter("kind = 'field'").groupBy(F.concat(F.lit("P"), "id").alias("callee")).agg(F.min("file").alias("to_file"))
    return u.join(s, "callee").filter("from_file <> to_file").groupBy("access", "from_file", "to_file").agg(F.sum("n").alias("edge_count"), F.max("best").alias("confidence"))


@query(sql("symbols", "calls", rest="SELECT c.callee, c.file, count(*) AS n FROM calls c WHERE EXISTS (SELECT 1 FROM symbols s WHERE s.file = c.file AND 'P'||(s.id % 300) = c.callee) GROUP BY ALL"))
def jn08_same_file_names(spark, sf_dir):
    s = symbols(spark, sf_dir).select("file", F.concat(F.lit("P"), F.col("id") % 300).alias("callee"))
    return calls(spark, sf_dir).join(s, ["file", "callee"], "left_semi").groupBy("callee", "file").agg(F.count(ONE).alias("n"))


@query(sql("symbols", "calls", rest="SELECT c.callee, c.n, (SELECT min(s.fq_name) FROM symbols s WHERE 'P'||(s.id % 700) = c.callee) AS resolved FROM (SELECT callee, count(*) AS n FROM calls GROUP BY callee) c"))
def jn10_least_name(spark, sf_dir):
    s = symbols(spark, sf_dir).groupBy(F.concat(F.lit("P"), F.col("id") % 700).alias("callee")).agg(F.min("fq_name").alias("resolved"))
    return calls(spark, sf_dir).groupBy("callee").agg(F.count(ONE).alias("n")).join(s, "callee", "left").select("callee", "n", "resolved")


@query(sql("symbols", rest="SELECT fq_name, file, line, kind FROM symbols WHERE (fq_name, file, line) IN (SELECT p_brand||'.'||p_name||'.'||p_partkey, 'src/'||(p_partkey % 97)||'.java', p_size FROM part WHERE p_retailprice > 905)"))
def jn14_three_keys(spark, sf_dir):
    keys = read(spark, sf_dir, "part").filter("p_retailprice > 905").selectExpr("concat(p_brand, '.', p_name, '.', p_partkey) AS fq_name", "concat('src/', p_partkey % 97, '.java') AS file", "cast(p_size AS bigint) AS line")
    return symbols(spark, sf_dir).join(keys, ["fq_name", "file", "line"], "left_semi").select("fq_name", "file", "line", "kind")


@query(sql("calls", rest="SELECT caller, callee, file, line, tier FROM calls WHERE callee IN (SELECT 'P'||o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 3 = 0)"))
def jn15_listed_names(spark, sf_dir):
    names = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_custkey % 3 = 0").select(F.concat(F.lit("P"), "o_custkey").alias("callee"))
    return calls(spark, sf_dir).join(names, "callee", "left_semi").select("caller", "callee", "file", "line", "tier")


@query("""WITH f AS (SELECT p_partkey AS id, 'repo' || p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'Part' || (p_partkey % 500) || 'Repository' WHEN 1 THEN 'Plain' || p_partkey WHEN 2 THEN 'Box' || p_partkey || 'Client<T>' END AS type FROM part),
 t AS (SELECT DISTINCT lower(CASE l_linenumber % 3 WHEN 0 THEN 'this.Part' || (l_partkey % 90) || 'Repository.save' WHEN 1 THEN 'box' || (l_partkey - l_partkey % 2) || 'client.get' ELSE 'x.repo' || (l_partkey - l_partkey % 2) || '.go' END) AS t FROM lineitem)
 SELECT id, name FROM f WHERE id % 3 <> 1 AND NOT EXISTS (SELECT 1 FROM t WHERE contains(t.t, lower(replace(f.type, '<T>', ''))) OR contains(t.t, f.name))""")
def jn17_not_called_services(spark, sf_dir):
    f = read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "concat('repo', p_partkey) AS name", "CASE p_partkey % 3 WHEN 0 THEN concat('Part', p_partkey % 500, 'Repository') WHEN 1 THEN concat('Plain', p_partkey) ELSE concat('Box', p_partkey, 'Client<T>') END AS type")
    t = read(spark, sf_dir, "lineitem").selectExpr("CASE l_linenumber % 3 WHEN 0 THEN concat('this.Part', l_partkey % 90, 'Repository.save') WHEN 1 THEN concat('box', l_partkey - l_partkey % 2, 'client.get') ELSE concat('x.repo', l_partkey - l_partkey % 2, '.go') END AS text")
    return N.not_called(f, t).select("id", "name")


@query(sql("calls", rest="SELECT pass, caller, callee, file, line, tier, confidence FROM (SELECT CASE WHEN callee IN ('P17', 'S3') OR caller IN ('P17', 'S3') THEN 0 ELSE 1 END AS pass, * FROM calls WHERE contains(lower(callee), 'p17') OR contains(lower(caller), 'p17') OR contains(lower(callee), 's3') OR contains(lower(caller), 's3'))"))
def jn19_edges_by_needles(spark, sf_dir):
    return V.named_edges(calls(spark, sf_dir), ["P17", "S3"]).select("pass", "caller", "callee", "file", "line", "tier", "confidence")


@query(sql("files", "symbols", "calls", "deps", "endpoints", rest="""SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM lineitem WHERE l_linenumber = 1) AS imports, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') AS field_usages, (SELECT count(*) FROM calls) AS call_edges,
 (SELECT count(*) FROM calls WHERE tier IN ('primary','provider')) AS call_edges_primary, (SELECT count(*) FROM calls WHERE tier = 'low_signal') AS call_edges_low_signal, (SELECT count(*) FROM calls WHERE tier = 'provider') AS call_edges_provider, (SELECT count(*) FROM deps) AS dependency_edges,
 (SELECT count(*) FROM files) + (SELECT count(*) FROM symbols) AS graph_nodes, (SELECT count(*) FROM (SELECT DISTINCT caller, callee FROM calls)) AS graph_edges, (SELECT count(*) FROM endpoints) AS endpoints, (SELECT count(*) FROM supplier) AS beans, (SELECT count(*) FROM endpoints WHERE id % 3 <> 0) AS endpoint_path_unresolved"""))
def ag01_snapshot_stats(spark, sf_dir):
    li, c, e = read(spark, sf_dir, "lineitem"), calls(spark, sf_dir), endpoints(spark, sf_dir)
    n = F.count(ONE)
    parts = [
        files(spark, sf_dir).agg(n.alias("files")), symbols(spark, sf_dir).agg(n.alias("symbols")), li.agg(F.count_if(F.col("l_linenumber") == 1).alias("imports"), F.count_if(F.col("l_linestatus") == "O").alias("field_usages")),
        c.agg(n.alias("call_edges"), F.count_if(F.col("tier").isin("primary", "provider")).alias("call_edges_primary"), F.count_if(F.col("tier") == "low_signal").alias("call_edges_low_signal"), F.count_if(F.col("tier") == "provider").alias("call_edges_provider"), F.countDistinct("caller", "callee").alias("graph_edges")),
        dependencies(spark, sf_dir).agg(n.alias("dependency_edges")), e.agg(n.alias("endpoints"), F.count_if(F.col("id") % 3 != 0).alias("endpoint_path_unresolved")), read(spark, sf_dir, "supplier").agg(n.alias("beans")),
    ]
    return R.side_by_side(parts).withColumn("graph_nodes", F.col("files") + F.col("symbols"))


@query(sql("files", "endpoints", rest="SELECT 'file_role' AS dim, role AS value, count(*) AS n FROM files GROUP BY role UNION ALL SELECT 'language', language, count(*) FROM files GROUP BY ALL UNION ALL SELECT 'parse_status', CASE WHEN doc_id % 9 = 0 THEN 'error' ELSE 'ok' END, count(*) FROM files GROUP BY ALL UNION ALL SELECT 'method', method, count(*) FROM endpoints GROUP BY ALL UNION ALL SELECT 'path_resolution', CASE WHEN id % 3 = 0 THEN 'exact' ELSE 'partial' END, count(*) FROM endpoints GROUP BY ALL"))
def ag08_file_and_endpoint_facets(spark, sf_dir):
    f = files(spark, sf_dir).select(F.col("role").alias("file_role"), "language", F.when(F.col("doc_id") % 9 == 0, "error").otherwise("ok").alias("parse_status"))
    e = endpoints(spark, sf_dir).select("method", F.when(F.col("id") % 3 == 0, "exact").otherwise("partial").alias("path_resolution"))
    return R.facets(f, f.columns).union(R.facets(e, e.columns))


@query(sql("calls", rest="""WITH g AS (SELECT file AS key, count(*) AS n, string_agg(DISTINCT tier, ',' ORDER BY tier) AS kinds FROM calls GROUP BY file), r AS (SELECT file AS key, line||':'||caller||'>'||callee AS row, row_number() OVER (PARTITION BY file ORDER BY line, caller, callee, confidence, tier) AS rn FROM calls)
 SELECT key, n, kinds, string_agg(row, ' ' ORDER BY rn) AS first_rows FROM g JOIN r USING (key) WHERE rn <= 10 GROUP BY ALL"""))
def ag09_groups_with_rows(spark, sf_dir):
    rows = calls(spark, sf_dir).withColumn("row", F.concat(F.col("line"), F.lit(":"), F.col("caller"), F.lit(">"), F.col("callee")))
    return R.groups_with_rows(rows, F.col("file"), "tier", "row", [F.col(c) for c in ("line", "caller", "callee", "confidence", "tier")], 10)


@query(sql("calls", rest="SELECT caller, callee, count(*) AS n, string_agg(DISTINCT line::VARCHAR, ',' ORDER BY line::VARCHAR) AS lines, max(confidence) AS confidence FROM calls GROUP BY ALL"))
def ag13_edges_with_lines(spark, sf_dir):
    return calls(spark, sf_dir).groupBy("caller", "callee").agg(F.count(ONE).alias("n"), F.array_join(F.sort_array(F.collect_set(F.col("line").cast("string"))), ",").alias("lines"), F.max("confidence").alias("confidence"))


@query(sql("found_symbols", "endpoints", "found_endpoints", rest="""WITH f AS (SELECT DISTINCT file AS path, package AS module FROM found_symbols), c AS (SELECT f.*, coalesce(s.n, 0) AS s, coalesce(e.n, 0) AS e FROM f LEFT JOIN (SELECT file AS path, count(*) AS n FROM found_symbols GROUP BY 1) s USING (path) LEFT JOIN (SELECT file AS path, count(*) AS n FROM found_endpoints GROUP BY 1) e USING (path)),
 r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY e * 100 + s DESC, path) AS rn FROM c) SELECT module, count(*) AS n_files, sum(s)::BIGINT AS n_symbols, sum(e)::BIGINT AS n_endpoints, string_agg(path, ' ' ORDER BY rn) FILTER (rn <= 6) AS top_files FROM r GROUP BY module"""))
def ag16_module_top_files(spark, sf_dir):
    s = search_symbols(spark, sf_dir)
    return A.module_rollup(s.select(F.col("file").alias("path"), F.col("package").alias("module")).distinct(), s.select("file"), file_endpoints(spark, sf_dir).select("file"))


_FLAGS = "CAST(json_extract_string(args, '$.k') AS INT)"


@query(sql("log", rest=f"""WITH l AS (SELECT *, {_FLAGS} AS k FROM log) SELECT count(*) AS events, count(*) FILTER (k % 5 = 0) AS stale, count(*) FILTER (k % 7 = 0) AS degraded, count(*) FILTER (k % 11 = 0) AS debug_timed, count(*) FILTER (k % 7 = 0 OR k % 13 = 0) AS fallback, floor(sum(duration_ms) / count(*) + 0.5)::BIGINT AS avg_ms, max(duration_ms) AS max_ms,
 (SELECT duration_ms FROM (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) AS rn, count(*) OVER () AS c FROM log) WHERE rn = ceil(0.95 * c)) AS p95_ms FROM l"""))
def ag18_log_totals(spark, sf_dir):
    k = F.get_json_object("args", "$.k").cast("int")
    log = query_log(spark, sf_dir).select("duration_ms", (k % 5 == 0).alias("stale"), (k % 7 == 0).alias("degraded"), (k % 11 == 0).alias("debug_timed"), (k % 13 == 0).alias("reason"))
    return R.log_totals(log)


@query(sql("log", rest=f"""WITH l AS (SELECT *, {_FLAGS} AS k FROM log), t AS (SELECT tool, count(*) FILTER (k % 50 = 0) AS invalid, count(*) FILTER (k % 5 = 0) AS stale, count(*) FILTER (k % 7 = 0) AS degraded, count(*) FILTER (k % 13 = 0) AS fallback, max(duration_ms) * 80 AS max_ms FROM l GROUP BY tool),
 s AS (SELECT tool, 100 - least(invalid, 25) - least(stale * 4, 20) - least(degraded * 3, 18) - least(fallback // 2 * 2, 10) - CASE WHEN max_ms >= 5000 THEN least(12, floor((max_ms - 5000) / 500)) ELSE 0 END AS score FROM t)
 SELECT tool, greatest(score, 0)::BIGINT AS score, CASE WHEN score >= 96 THEN 'A+' WHEN score >= 92 THEN 'A' WHEN score >= 84 THEN 'B+' WHEN score >= 76 THEN 'B' WHEN score >= 64 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END AS grade FROM s"""))
def ag20_log_grade(spark, sf_dir):
    k = F.get_json_object("args", "$.k").cast("int")
    log = query_log(spark, sf_dir).groupBy("tool").agg(F.count_if(k % 50 == 0).alias("invalid"), F.count_if(k % 5 == 0).alias("stale"), F.count_if(k % 7 == 0).alias("degraded"), F.count_if(k % 13 == 0).alias("fallback"), (F.max("duration_ms") * 80).alias("max_ms"))
    return log.select("tool", R.log_score().alias("score")).withColumn("grade", R.grade("score"))


@query(sql("found_symbols", rest="SELECT name, min(id) AS first_id, row_number() OVER (ORDER BY min(id), name) AS rank FROM found_symbols GROUP BY name"))
def so05_ordered_distinct(spark, sf_dir):
    s = search_symbols(spark, sf_dir).select("name", F.col("id").alias("first_id"))
    return A.ordered_distinct(s, "name", "first_id").select("name", "first_id", F.col("rank").cast("bigint").alias("rank"))


@query(sql("calls", rest="""WITH e AS (SELECT caller, callee, max(confidence) AS score FROM calls GROUP BY ALL), n AS (SELECT id, max(score) AS score FROM (SELECT caller AS id, (CASE WHEN caller IN ('S1', 'S2', 'S3') THEN 101 ELSE count(*) * 7919 % 101 END)::DOUBLE AS score FROM calls GROUP BY 1 UNION ALL SELECT callee, count(*) * 7919 % 101 FROM calls GROUP BY 1) GROUP BY id ORDER BY score DESC, id LIMIT 60)
 SELECT caller AS source, callee AS target, score FROM e WHERE caller IN (SELECT id FROM n) AND callee IN (SELECT id FROM n) ORDER BY score DESC, source, target LIMIT 100"""))
def so06_capped_graph(spark, sf_dir):
    c = calls(spark, sf_dir)
    n = c.select("caller").union(c.select("callee")).groupBy(F.col("caller").alias("id")).agg((F.count(ONE) * 7919 % 101).cast("double").alias("score"))
    n = n.withColumn("score", F.when(F.col("id").isin("S1", "S2", "S3"), 101.0).otherwise(F.col("score")))
    return A.within_caps(n, c.select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.col("confidence").alias("score")), 60, 100)[1]


@query(sql("symbols", "calls", "deps", rest="""SELECT kind, file, line, name, access FROM (SELECT 'definition' AS kind, file, line, fq_name AS name, NULL::VARCHAR AS access FROM symbols WHERE id % 100 = 7 UNION ALL SELECT 'call', file, line, callee, NULL FROM calls WHERE callee = 'P7' UNION ALL SELECT 'import', 'src/'||(a % 97)||'.java', NULL, 'P'||b, NULL FROM deps WHERE b = 7
 UNION ALL SELECT 'field_usage', 'src/'||(l_orderkey % 97)||'.java', l_linenumber::BIGINT, 'P'||l_partkey, l_linestatus FROM lineitem WHERE l_partkey = 7 AND l_returnflag <> 'R') ORDER BY file, line NULLS FIRST, kind, name, access NULLS FIRST LIMIT 40 OFFSET 3"""))
def st01_four_reference_kinds(spark, sf_dir):
    d = symbols(spark, sf_dir).filter("id % 100 = 7").select(F.lit("definition").alias("kind"), "file", "line", F.col("fq_name").alias("name"))
    c = calls(spark, sf_dir).filter("callee = 'P7'").select(F.lit("call").alias("kind"), "file", "line", F.col("callee").alias("name"))
    i = dependencies(spark, sf_dir).filter("b = 7").select(F.lit("import").alias("kind"), F.concat(F.lit("src/"), F.col("a") % 97, F.lit(".java")).alias("file"), F.concat(F.lit("P"), F.col("b")).alias("name"))
    u = read(spark, sf_dir, "lineitem").filter("l_partkey = 7 AND l_returnflag <> 'R'").selectExpr("'field_usage' AS kind", "concat('src/', l_orderkey % 97, '.java') AS file", "cast(l_linenumber AS bigint) AS line", "concat('P', l_partkey) AS name", "l_linestatus AS access")
    every = d.unionByName(c, True).unionByName(i, True).unionByName(u, True)
    return R.page(every, [F.col(x) for x in ("file", "line", "kind", "name", "access")], 3, 40).select("kind", "file", "line", "name", "access")


_W = "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), t AS (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: starts_with(x, 'wort'))) AS f0, len(list_filter(w, lambda x: starts_with(x, 'license'))) AS f1 FROM w), s AS (SELECT count(*) AS n, avg(len) AS al, count(*) FILTER (f0>0) AS d0, count(*) FILTER (f1>0) AS d1 FROM t)"


@query(f"{_W} SELECT doc_id, round(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / al)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / al)), 6) AS score FROM t CROSS JOIN s WHERE f0 + f1 > 0 ORDER BY score DESC, doc_id LIMIT 10")
def so04_bm25_top(spark, sf_dir):
    return S.bm25(read(spark, sf_dir, "documents"), "doc_id", "text", "wort license").select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END AS parameters, 'redBoltName' AS camel FROM part")
def fn_signatures(spark, sf_dir):
    sig = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'void a( )' WHEN 1 THEN 'int b(Map<String, List<Integer>> m, int[] x)' WHEN 2 THEN 'c(Function<A, B> f) throws X' ELSE 'd(int a, g(1, 2) b, {x, y} c)' END")
    from ..functions import text as T

    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.parameter_count(sig).alias("parameters"), T.lower_camel(F.lit("RED__bolt_name")).alias("camel"))


@query(sql("log", rest="SELECT session, id, key, reused FROM (SELECT session, id, tool AS key, row_number() OVER (PARTITION BY session, id // 2000, tool ORDER BY ts, id) > 1 AS reused FROM log)"))
def sm05_ledger_by_snapshot(spark, sf_dir):
    again = F.row_number().over(W.partitionBy("session", F.floor(F.col("id") / 2000), "tool").orderBy("ts", "id")) > 1
    return query_log(spark, sf_dir).select("session", "id", F.col("tool").alias("key"), again.alias("reused"))
