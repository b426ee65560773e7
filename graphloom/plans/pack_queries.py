"""Queries of snapshots, the gate, checkpoints and composed answers, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import failures as X
from ..operators import gate as H
from ..operators import ledger as L
from ..operators import packs as P
from ..operators import ranking as K
from ..operators import relational as R
from ..operators import search as S
from ..operators import snapshots as N
from ..operators.tables import calls, dependencies, file_endpoints, files, query_log, read, search_files, search_symbols, sql, symbols
from ..sources import code as C
from ..sources import frameworks as W
from ..sources import specs as Y
from .registry import query

ONE = "*"  # what a count counts

_TREE = "concat(CASE doc_id % 16 WHEN 0 THEN 'a/vendor/' WHEN 1 THEN 'x-generated/' WHEN 2 THEN 'src/test/' WHEN 3 THEN 'e2e_test/' WHEN 4 THEN 'latest/' WHEN 5 THEN 'mocks/' WHEN 6 THEN 'a/build/' WHEN 7 THEN 'gen/' ELSE 'src/' END, CASE doc_id % 7 WHEN 0 THEN 'Main.java' WHEN 1 THEN 'pom.xml' WHEN 2 THEN 'b.spec.ts' WHEN 3 THEN 'conf.yaml' WHEN 4 THEN 'run.sh' WHEN 5 THEN 'AppTests.java' ELSE 'm.g.java' END)"


@query(f"""SELECT doc_id, path, CASE WHEN d IN (0, 6) THEN 'vendored' WHEN d = 1 OR f = 6 THEN 'generated' WHEN f = 1 THEN 'build_config' WHEN f IN (3, 4) THEN 'resource_config' WHEN d = 5 THEN 'mock_source' WHEN d IN (2, 3) OR f IN (2, 5) THEN 'test_source' ELSE 'main_source' END AS role,
 CASE WHEN f IN (0, 5, 6) THEN 'java' WHEN f = 1 THEN 'xml' WHEN f = 2 THEN 'typescript' WHEN f = 3 THEN 'yaml' END AS language FROM (SELECT doc_id, {_TREE} AS path, doc_id % 16 AS d, doc_id % 7 AS f FROM documents)""")
def src05_roles(spark, sf_dir):
    d = read(spark, sf_dir, "documents").selectExpr("doc_id", f"{_TREE} AS path")
    return d.select("doc_id", "path", C.role_of(F.col("path")).alias("role"), C.language_of(F.col("path")).alias("language"))


@query(sql("files", rest="SELECT path, blob_hash = old AS reused FROM (SELECT f.path, f.blob_hash, coalesce(CASE WHEN doc_id % 3 = 0 THEN sha256('old') END, f.blob_hash) AS b2, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN f.blob_hash ELSE 'x' END AS old FROM files f)"))
def src02_reused_hashes(spark, sf_dir):
    f = files(spark, sf_dir).select("doc_id", "path", "size", F.lit(5).alias("mtime"), "blob_hash")
    before = f.filter("doc_id % 3 = 0").select("path", "size", F.when(F.col("doc_id") % 2 == 0, 5).otherwise(6).alias("mtime"), F.lit("old").alias("blob_hash"))
    out = C.reuse_hashes(f, before)
    return out.select("path", (F.col("blob_hash") == "old").alias("reused"))


@query(sql("log", rest="SELECT id, tool FROM log WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND tool = 'click' AND id % 2 = 0 ORDER BY ts DESC, id DESC LIMIT 30"))
def src12_log_window(spark, sf_dir):
    log = query_log(spark, sf_dir).withColumn("event", F.when(F.col("id") % 2 == 0, "query").otherwise("start"))
    return C.log_window(log, "2024-01-03 00:00:00", "2024-01-20 12:00:00", "click", "query", 30).select("id", "tool")


@query(sql("files", rest="SELECT path, CASE WHEN k IN (0, 1) THEN 'present' WHEN k = 2 THEN 'deleted' ELSE 'unknown' END AS status FROM (SELECT path, doc_id % 4 AS k FROM files WHERE doc_id % 3 = 1)"))
def src03_scoped_paths(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("k", F.col("doc_id") % 4)
    return N.scoped(f.filter("k < 2"), f.filter("k IN (1, 2)"), f.filter("doc_id % 3 = 1"))


@query(sql("symbols", rest="SELECT file, line, name, provider, kind FROM (SELECT file, line, name, provider, kind, row_number() OVER (PARTITION BY file, line, name ORDER BY p) AS rn FROM (SELECT file, line, name, 'syntax' AS provider, 0 AS p, kind FROM (SELECT file, line, name, min(kind) AS kind FROM symbols WHERE id % 2 = 0 GROUP BY ALL) UNION ALL SELECT file, line, name, 'index', 1, min(kind) FROM symbols WHERE id % 3 = 0 GROUP BY ALL)) WHERE rn = 1"))
def src11_merged_providers(spark, sf_dir):
    s = symbols(spark, sf_dir)
    part = lambda n: s.filter(f"id % {n} = 0").groupBy("file", "line", "name").agg(F.min("kind").alias("kind"))
    return N.merged_providers({"syntax": part(2), "index": part(3)}, ["file", "line", "name"]).select("file", "line", "name", "provider", "kind")


@query("SELECT 'f' || doc_id AS path, n AS name, v AS value, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS left_out FROM documents, (VALUES (1, 'a.b', '1'), (2, 'c-d', 'x y'), (3, 'e', '')) AS x(k, n, v) WHERE k <= 2 OR doc_id % 2 = 2")
def src09_config_lines(spark, sf_dir):
    d = read(spark, sf_dir, "documents").selectExpr("concat('f', doc_id) AS path", "'properties' AS language", "encode(concat('# note\n a.b = 1\nc-d:  x y \n', CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'e=' END), 'UTF-8') AS content")
    return C.config_facts(d, 2)


_YAML = "concat('openapi: 3.0.0\nbasePath: /v', doc_id % 3, '\npaths:\n  /a', doc_id, ':\n    # get: no\n    get:\n      operationId: read', doc_id, '\n      responses:\n        get: x\n    parameters: []\n  \"/b/{id}\":\n    POST:\n      summary: s\ncomponents:\n  /c:\n    get:\n')"


@query("SELECT 'f' || doc_id AS path, m AS method, '/v' || (doc_id % 3) || replace(r, '#', doc_id::VARCHAR) AS route, CASE m WHEN 'GET' THEN 'read' || doc_id END AS name, 0.75::DOUBLE AS confidence FROM documents, (VALUES ('GET', '/a#'), ('POST', '/b/{id}')) AS v(m, r)")
def src09_openapi_yaml(spark, sf_dir):
    d = read(spark, sf_dir, "documents").selectExpr("concat('f', doc_id) AS path", f"replace({_YAML}, '        get: x\n', '        ok: x\n') AS content")
    return Y.openapi_yaml_endpoints(d)


_ES = "concat('{\"cluster.h', doc_id, '\":{\"url\":{\"paths\":[{\"path\":\"/_c/', doc_id, '\",\"methods\":[\"GET\",\"head\"]},{\"path\":\"/x\",\"methods\":[\"PUT\"]}]}}}')"


@query("SELECT 'f' || doc_id AS path, m AS method, replace(r, '#', doc_id::VARCHAR) AS route, 'cluster.h' || doc_id AS name, 0.75::DOUBLE AS confidence FROM documents, (VALUES ('GET', '/_c/#'), ('HEAD', '/_c/#'), ('PUT', '/x')) AS v(m, r)")
def src09_elastic_specs(spark, sf_dir):
    return Y.elastic_endpoints(read(spark, sf_dir, "documents").selectExpr("concat('f', doc_id) AS path", f"{_ES} AS content"))


_DIFF = "concat('diff --git a/f', doc_id % 50, ' b/f', doc_id % 50, '\\n--- a/f', doc_id % 50, '\\n+++ b/f', doc_id % 50, '\\n@@ -', doc_id + 1, ',3 +', doc_id + 2, ',4 @@\\n a\\n-b\\n+c\\n+d\\n@@ -900,1 +901,1 @@\\n-x\\n+y')"


@query("SELECT 'f' || (doc_id % 50) AS file, h AS hunk, CASE h WHEN 1 THEN doc_id + 1 ELSE 900 END::INT AS old_start, CASE h WHEN 1 THEN doc_id + 2 ELSE 901 END::INT AS new_start, CASE h WHEN 1 THEN 2 ELSE 1 END AS added, 1 AS removed, CASE h WHEN 1 THEN 1 ELSE 0 END AS context FROM documents, (VALUES (1), (2)) AS v(h)")
def src13_diff_hunks(spark, sf_dir):
    return C.diff_hunks(read(spark, sf_dir, "documents").selectExpr(f"{_DIFF} AS diff"))


@query("SELECT 'f' || (doc_id % 50) AS file, 3 AS added, 2 AS removed, doc_id FROM documents")
def src14_diff_blocks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 10).alias("g")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", F.expr(_DIFF).alias("t")))), lambda x: F.concat(x["t"], F.lit("\n#"), x["doc_id"])), "\n").alias("diff"))
    return C.diff_blocks(d, "diff").select("file", "added", "removed", F.regexp_extract("block", r"\n#(\d+)\s*$", 1).cast("bigint").alias("doc_id"))


@query(sql("symbols", rest="SELECT 'symbols' AS fact, file, name, kind FROM symbols UNION ALL SELECT 'calls', file, name, 'call' FROM symbols WHERE id % 2 = 0"))
def snk03_fact_shards(spark, sf_dir):
    s = symbols(spark, sf_dir).groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("name", "kind")).alias("symbols"), F.collect_list(F.when(F.col("id") % 2 == 0, F.struct("name", F.lit("call").alias("kind")))).alias("calls"))
    out = None
    for fact, df in N.fact_shards(s, ("symbols", "calls")).items():
        part = df.select(F.lit(fact).alias("fact"), F.col("path").alias("file"), "name", "kind")
        out = part if out is None else out.union(part)
    return out


@query("SELECT o_custkey AS workspace, o_orderkey AS snapshot FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 10 = 0) DESC, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3")
def snk05_retained_snapshots(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("workspace"), F.col("o_orderkey").alias("snapshot"), (F.col("o_orderkey") % 10 == 0).alias("current"), F.col("o_orderdate").alias("created"))
    return R.retained(o, "workspace", "current", "created", "snapshot").select("workspace", "snapshot")


@query(sql("calls", rest="""WITH e AS (SELECT caller AS source, callee AS target, 'calls' AS type, count(*) AS edge_count FROM calls WHERE tier = 'provider' GROUP BY ALL) SELECT '{"record":"node","id":"'||id||'"}' AS value FROM (SELECT source AS id FROM e UNION SELECT target FROM e) UNION ALL SELECT '{"record":"edge","source":"'||source||'","target":"'||target||'","type":"calls","edge_count":'||edge_count||'}' FROM e"""))
def snk06_graph_json(spark, sf_dir):
    e = calls(spark, sf_dir).filter("tier = 'provider'").groupBy(F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit("calls").alias("type")).agg(F.count(ONE).alias("edge_count"))
    return X.graph_json(e)


@query("WITH r AS (SELECT r_name, r_regionkey, row_number() OVER (ORDER BY r_regionkey DESC) AS rn FROM region) SELECT 1 AS place, '| r_name | r_regionkey |' AS line UNION ALL SELECT 2, '|---|---|' UNION ALL SELECT (rn + 2)::INT, '| ' || r_name || ' | ' || r_regionkey || ' |' FROM r")
def snk07_markdown(spark, sf_dir):
    return N.markdown_table(read(spark, sf_dir, "region").select("r_name", "r_regionkey"), [F.desc("r_regionkey")])


@query("""SELECT '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"review"}},"results":[' || string_agg('{"ruleId":"r'||(n_nationkey % 3)||'","level":"'||CASE n_nationkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END||'","message":{"text":"'||n_name||'"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"f'||n_regionkey||'"},"region":{"startLine":'||(n_nationkey + 1)||'}}}]}', ',' ORDER BY n_nationkey % 3, 'f'||n_regionkey, 'r'||(n_nationkey % 3), n_nationkey) || ']}]}' AS value FROM nation""")
def snk07_sarif(spark, sf_dir):
    n = read(spark, sf_dir, "nation").selectExpr("concat('r', n_nationkey % 3) AS rule", "concat('P', n_nationkey % 3) AS priority", "concat('f', n_regionkey) AS file", "n_nationkey + 1 AS line", "n_name AS message")
    return N.sarif(n, "review")


@query("SELECT '-Dtest=' || string_agg(DISTINCT 'T' || (n_nationkey % 7), ',' ORDER BY 'T' || (n_nationkey % 7)) AS value FROM nation UNION ALL SELECT string_agg('--tests ' || t, ' ' ORDER BY t) FROM (SELECT DISTINCT 'T' || (n_nationkey % 7) AS t FROM nation) UNION ALL SELECT 'd' || n_regionkey || '/T' || (n_nationkey % 7) || '.java' FROM nation")
def snk07_test_lists(spark, sf_dir):
    t = read(spark, sf_dir, "nation").selectExpr("concat('d', n_regionkey, '/T', n_nationkey % 7, '.java') AS path")
    return N.test_list(t, "maven").union(N.test_list(t, "gradle")).union(N.test_list(t, "list"))


@query(sql("symbols", rest="SELECT file, name, kind, id FROM symbols WHERE file NOT IN ('src/3.java', 'src/5.java', 'src/8.java') UNION ALL SELECT file, name || 'New', kind, id FROM symbols WHERE file IN ('src/3.java', 'src/5.java')"))
def sm02_refreshed_facts(spark, sf_dir):
    s = symbols(spark, sf_dir).select("file", "name", "kind", "id")
    changed = spark.createDataFrame([(f"src/{k}.java",) for k in (3, 5, 8)], "file string")
    fresh = s.filter("file IN ('src/3.java', 'src/5.java')").withColumn("name", F.concat("name", F.lit("New")))
    return N.refreshed(s, fresh, changed, "file")


@query(sql("deps", rest="SELECT DISTINCT path FROM (SELECT p_partkey AS path FROM part WHERE p_partkey IN (4, 9, 30) UNION ALL SELECT a FROM deps WHERE b IN (4, 9, 30))"))
def sm02_affected_sources(spark, sf_dir):
    return N.affected_sources(dependencies(spark, sf_dir), read(spark, sf_dir, "part").filter("p_partkey IN (4, 9, 30)").select(F.col("p_partkey").alias("path")))


def _changes(spark, sf_dir):
    f = files(spark, sf_dir)
    now = f.filter("doc_id % 10 <> 0").select("path", F.when(F.col("doc_id") % 7 == 0, F.lit("z")).otherwise(F.col("blob_hash")).alias("blob_hash"))
    return R.snapshot_diff(now, f.filter("doc_id % 9 <> 0"))


_CH = "c AS (SELECT path, doc_id % 10 <> 0 AS n, doc_id % 9 <> 0 AS o, doc_id % 7 = 0 AS m FROM files WHERE doc_id % 10 <> 0 OR doc_id % 9 <> 0), k AS (SELECT path, CASE WHEN NOT o THEN 'added' WHEN NOT n THEN 'deleted' WHEN m THEN 'modified' ELSE 'unchanged' END AS change FROM c)"


@query(sql("files", rest=f"WITH {_CH} SELECT changed, l AS \"limit\", changed > 0 AND changed <= l AS incremental FROM (SELECT count(*) FILTER (change <> 'unchanged') AS changed, (SELECT greatest(1, least(500, ceil(count(*) * 0.2)))::BIGINT FROM files) AS l FROM k)"))
def sm02_refresh_decision(spark, sf_dir):
    return N.refresh_decision(_changes(spark, sf_dir), files(spark, sf_dir).count())


@query(sql("files", rest=f"WITH {_CH} SELECT count(*) FILTER (change <> 'unchanged') > 0 AS stale, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'unchanged') AS unchanged, (SELECT string_agg(path, ' ' ORDER BY path) FROM (SELECT path FROM k WHERE change <> 'unchanged' ORDER BY path LIMIT 20)) AS samples FROM k"))
def sm03_freshness(spark, sf_dir):
    return N.freshness(_changes(spark, sf_dir))


@query("""WITH r AS (SELECT event_id, user_id, epoch_us(ts) AS b, epoch_us(ts) + (value * 40000000)::BIGINT AS e FROM events), p AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM r)
 SELECT event_id, user_id, sum(CASE WHEN u IS NULL OR b > u THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM p""")
def sm04_coalesced_requests(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr("event_id", "user_id", "unix_micros(cast(ts AS timestamp)) AS b", "unix_micros(cast(ts AS timestamp)) + cast(value * 40000000 AS bigint) AS e")
    return N.coalesced(e, "user_id", "b", "e", "event_id").select("event_id", "user_id", "run")


_PHASE = "['discovery','impact','implementation','verification','review','complete','other']"


@query(sql("log", rest=f"""WITH p AS (SELECT session AS task, id AS version, {_PHASE}[(id * 5 // 3 % 7 + 1)::INT] AS phase FROM log), b AS (SELECT *, lag(phase) OVER (PARTITION BY task ORDER BY version) AS before FROM p)
 SELECT task, version, phase, before, phase <> 'other' AND (before IS NULL OR before = phase OR before || '>' || phase IN ('discovery>impact', 'discovery>implementation', 'impact>implementation', 'implementation>verification', 'verification>implementation', 'verification>review', 'verification>complete', 'review>implementation', 'review>verification', 'review>complete')) AS allowed FROM b"""))
def sm06_phase_transitions(spark, sf_dir):
    names = F.array(*map(F.lit, ("discovery", "impact", "implementation", "verification", "review", "complete", "other")))
    c = query_log(spark, sf_dir).select(F.col("session").alias("task"), F.col("id").alias("version"), F.element_at(names, (F.expr("id * 5 div 3") % 7 + 1).cast("int")).alias("phase"))
    return L.transitions(c)


@query("""WITH c AS (SELECT p_partkey AS id, p_partkey % 20 AS f, p_partkey % 5 AS k FROM part) SELECT id, CASE WHEN f >= 17 THEN 'missing' WHEN k = 0 THEN 'fresh' WHEN k IN (1, 2) THEN 'relocated' WHEN k = 3 THEN 'stale' ELSE 'ambiguous' END AS status FROM c""")
def sm06_claim_status(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    c = p.selectExpr("p_partkey AS id", "concat('f', p_partkey % 20) AS file", "CASE p_partkey % 5 WHEN 0 THEN concat('h', p_partkey % 20) WHEN 4 THEN NULL ELSE 'old' END AS file_hash", "CASE p_partkey % 5 WHEN 1 THEN 's10' WHEN 2 THEN 's40' WHEN 3 THEN 's77' END AS slice_hash", "10 AS line", "3 AS width")
    f = spark.range(17).selectExpr("concat('f', id) AS file", "concat('h', id) AS hash")
    s = f.selectExpr("file", "explode(array(10, 20, 40)) AS line").selectExpr("file", "line", "3 AS width", "concat('s', line) AS hash")
    return L.claim_status(c, f, s)


@query("SELECT doc_id, len AS n_words, f0 AS n_wort, f1 AS n_mor FROM (SELECT doc_id, len(w) AS len, len(list_filter(w, lambda x: starts_with(x, 'wort'))) AS f0, len(list_filter(w, lambda x: starts_with(x, 'mor'))) AS f1 FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents))")
def ft02_prefix_counts(spark, sf_dir):
    c = S.phrase_counts(read(spark, sf_dir, "documents"), "doc_id", "text", S.query_terms("an wort* MOR wort"))
    return c.select("doc_id", F.col("len").alias("n_words"), F.col("tf0").alias("n_wort"), F.col("tf1").alias("n_mor"))


@query(sql("found_symbols", "calls", rest="""WITH t AS (SELECT 'RedBolt.run' AS term UNION ALL SELECT 'RedBolt'), f AS (SELECT DISTINCT file FROM found_symbols WHERE role IN ('test_source', 'mock_source')),
 s AS (SELECT file, 4 AS n FROM f, t WHERE contains(lower(file), lower(term)) UNION ALL SELECT file, 3 FROM (SELECT DISTINCT file, term FROM found_symbols, t WHERE role IN ('test_source', 'mock_source') AND (contains(lower(name), lower(term)) OR contains(lower(fq_name), lower(term)))) UNION ALL SELECT file, 6 FROM (SELECT DISTINCT y.file, t.term FROM calls c JOIN found_symbols y ON 'P' || y.id = c.callee CROSS JOIN t WHERE y.role IN ('test_source', 'mock_source') AND c.tier <> 'low_signal' AND c.caller = CASE t.term WHEN 'RedBolt' THEN 'S7' ELSE 'S3' END))
 SELECT file, sum(n)::BIGINT AS score FROM s GROUP BY file ORDER BY score DESC, file LIMIT 50"""))
def ft14_tests_by_terms(spark, sf_dir):
    s = search_symbols(spark, sf_dir)
    c = R.visible_calls(calls(spark, sf_dir)).join(s.select(F.concat(F.lit("P"), "id").alias("callee"), F.col("file").alias("f"), "role"), "callee").selectExpr("f AS file", "role", "caller", "callee")
    return S.relevant_tests(s.select(F.col("file").alias("path"), "role").distinct(), s, c, {"RedBolt.run": ["S3"], "RedBolt": ["S7"]}).limit(50)


@query("""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS weight FROM w GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rn FROM c)
 SELECT doc_id, sum(weight)::BIGINT AS score, string_agg(term, ' ' ORDER BY term) AS matched FROM n WHERE rn <= 160 AND term IN ('the', 'license', 'thand', 'wort') GROUP BY doc_id""")
def ft15_artifact_ranking(spark, sf_dir):
    return S.artifact_ranking(read(spark, sf_dir, "documents"), "doc_id", "text", ["the", "license", "thand", "wort"])


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents), h AS (SELECT doc_id, k, (contains(lower(t), 'license'))::INT + (contains(lower(t), 'wort'))::INT AS n FROM l) SELECT doc_id, sum(n)::BIGINT AS hits, min(k) AS first_line FROM h WHERE n > 0 GROUP BY doc_id""")
def ft16_live_scan(spark, sf_dir):
    return S.live_scan(read(spark, sf_dir, "documents"), "doc_id", "text", ["license", "wort"])


@query(sql("found_symbols", rest="""WITH s AS (SELECT *, CASE WHEN lower(name) = 'red' THEN 8 WHEN contains(lower(name), 'red') THEN 5 WHEN contains(lower(file), 'red') THEN 3 WHEN contains(lower(signature), 'red') THEN 1 ELSE 0 END + CASE WHEN lower(name) = 'bolt' THEN 8 WHEN contains(lower(name), 'bolt') THEN 5 WHEN contains(lower(file), 'bolt') THEN 3 WHEN contains(lower(signature), 'bolt') THEN 1 ELSE 0 END
 + CASE WHEN lower(name) = 'redbolt' THEN 8 WHEN contains(lower(name), 'redbolt') THEN 5 WHEN contains(lower(file), 'redbolt') THEN 3 ELSE 0 END + CASE WHEN kind IN ('class', 'interface') THEN 1 ELSE 0 END AS score FROM found_symbols) SELECT id, score, round(greatest(0.5, least(0.96, 0.35 + score / 10)), 4) AS confidence FROM s WHERE score > 0"""))
def tg01_gate_symbols(spark, sf_dir):
    s = search_symbols(spark, sf_dir).withColumn("confidence", F.lit(0.5))
    return H.gate_symbols(s, "RedBolt").select("id", "score", F.round("confidence", 4).alias("confidence"))


_NB = "CASE WHEN id % 6 = 0 THEN 'src/test/' ELSE 'src/main/' END || name || CASE WHEN id % 6 = 0 THEN 'Test.java' ELSE '.java' END"


@query(sql("found_symbols", rest=f"""WITH f AS (SELECT DISTINCT {_NB} AS path FROM found_symbols), s AS (SELECT path, CASE WHEN contains(lower(split_part(path, '/', 3)), 'red') THEN 3 ELSE 0 END + CASE WHEN contains(lower(split_part(path, '/', 3)), 'bolt') THEN 3 ELSE 0 END + CASE WHEN contains(lower(split_part(path, '/', 3)), 'redbolt') THEN 3 ELSE 0 END AS score, path LIKE 'src/test/%' AS t FROM f)
 SELECT 'source' AS section, path, CASE WHEN contains(lower(path), 'redbolt') THEN 7 ELSE score END AS score FROM s WHERE NOT t AND score > 0 QUALIFY row_number() OVER (ORDER BY CASE WHEN contains(lower(path), 'redbolt') THEN 7 ELSE score END DESC, path) <= 12
 UNION ALL SELECT 'test', path, score FROM s WHERE t AND score > 0 QUALIFY row_number() OVER (ORDER BY score DESC, path) <= 12"""))
def tg02_test_neighbours(spark, sf_dir):
    f = search_symbols(spark, sf_dir).select(F.expr("concat(CASE WHEN id % 6 = 0 THEN 'src/test/' ELSE 'src/main/' END, name, CASE WHEN id % 6 = 0 THEN 'Test.java' ELSE '.java' END)").alias("path")).distinct()
    return H.test_neighbours(f, "RedBolt")


_LOG = "concat('x\\n', CASE doc_id % 4 WHEN 0 THEN concat('src/a', doc_id, '.ts(', doc_id + 30, ',4): error TS1: bad') WHEN 1 THEN concat('[ERROR] /w/B', doc_id, '.java:[7,2] cannot find') WHEN 2 THEN concat('\\tat com.x.C.run(C', doc_id, '.java:', doc_id + 1, ')') ELSE concat('src/d.py:', doc_id, ':3: E1 oops') END, '\\nend')"


@query("SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'src/a' || doc_id || '.ts' WHEN 1 THEN '/w/B' || doc_id || '.java' WHEN 2 THEN 'C' || doc_id || '.java' ELSE 'src/d.py' END AS file, l AS line, CASE doc_id % 4 WHEN 0 THEN 'TS1: bad' WHEN 1 THEN 'cannot find' WHEN 2 THEN '' ELSE 'E1 oops' END AS message, greatest(l - 25, 1) AS from_line, greatest(l - 25, 1) + 89 AS to_line, 0 AS left_out FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id + 30 WHEN 1 THEN 7 WHEN 2 THEN doc_id + 1 ELSE doc_id END::INT AS l FROM documents)")
def tg03_failures(spark, sf_dir):
    return X.errors(read(spark, sf_dir, "documents").selectExpr("doc_id AS id", f"{_LOG} AS text"))


_JD = "concat('+++ b/src/main/A', doc_id % 20, '.java\\n+  @Inject\\n+  public int f(int a) {\\n-  import x.Y;\\n+  import x.Z;\\n q\\n+  String s = \"select a from t\";', CASE WHEN doc_id % 2 = 0 THEN '\\n-  private void g() {' ELSE '' END)"


@query("SELECT doc_id AS id, 'src/main/A' || (doc_id % 20) || '.java' AS file, 4 AS added, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS removed, 1 AS annotations, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS signatures, 2 AS imports, 1 AS sql FROM documents")
def tg04_diff_categories(spark, sf_dir):
    return X.diff_categories(read(spark, sf_dir, "documents").selectExpr("doc_id AS id", f"{_JD} AS diff"))


_CT = "concat('m', doc_id % 8, '/', CASE doc_id % 6 WHEN 0 THEN 'openapi.yaml' WHEN 1 THEN 'V1__schema.sql' WHEN 2 THEN 'OrderListener.java' WHEN 3 THEN 'SecurityTest.java' WHEN 4 THEN 'README.md' ELSE 'Plain.java' END) AS path"


@query(f"SELECT DISTINCT path, type FROM (SELECT {_CT}, doc_id % 8 AS m, doc_id % 6 AS k FROM documents), (VALUES (0, 'api'), (1, 'schema'), (2, 'messaging'), (3, 'security'), (3, 'test'), (4, 'docs')) AS v(kk, type) WHERE m IN (1, 2) AND k = kk")
def tg05_contracts(spark, sf_dir):
    f = read(spark, sf_dir, "documents").selectExpr(_CT).distinct()
    return X.contracts(f, spark.createDataFrame([("m1/X.java",), ("m2/Y.java",)], "path string"))


@query("SELECT type FROM (VALUES ('api'), ('schema'), ('messaging'), ('security'), ('test'), ('docs')) AS v(type) WHERE type NOT IN (SELECT CASE doc_id % 6 WHEN 0 THEN 'api' WHEN 1 THEN 'schema' WHEN 2 THEN 'messaging' WHEN 4 THEN 'docs' ELSE '' END FROM documents WHERE doc_id % 8 = 2) AND type NOT IN (SELECT unnest(['security', 'test']) FROM documents WHERE doc_id % 8 = 2 AND doc_id % 6 = 3)")
def tg05_missing_contracts(spark, sf_dir):
    f = read(spark, sf_dir, "documents").selectExpr(_CT).distinct()
    return X.missing_contracts(f, spark.createDataFrame([("m2/Y.java",)], "path string"))


@query("""WITH l AS (SELECT 'f' || doc_id AS file, doc_id + 1 AS line, CASE doc_id % 5 WHEN 0 THEN 'public class RedBolt {' WHEN 1 THEN '  x = RedBolt.of(1);' WHEN 2 THEN 'RedBolts r' WHEN 3 THEN ' def redbolt(a): ' ELSE 'none' END AS text FROM documents) SELECT kind, file, line, trim(text) AS text FROM (SELECT *, CASE WHEN text LIKE '%class%' OR text LIKE '%def%' THEN 'definition' ELSE 'usage' END AS kind, row_number() OVER (PARTITION BY (text LIKE '%class%' OR text LIKE '%def%') ORDER BY file, line) AS rn FROM l WHERE text NOT IN ('RedBolts r', 'none')) WHERE rn <= CASE kind WHEN 'definition' THEN 80 ELSE 120 END""")
def tg06_text_impact(spark, sf_dir):
    l = read(spark, sf_dir, "documents").selectExpr("concat('f', doc_id) AS file", "doc_id + 1 AS line", "CASE doc_id % 5 WHEN 0 THEN 'public class RedBolt {' WHEN 1 THEN '  x = RedBolt.of(1);' WHEN 2 THEN 'RedBolts r' WHEN 3 THEN ' def redbolt(a): ' ELSE 'none' END AS text")
    return H.text_impact(l, ["RedBolt"])


@query(sql("found_symbols", rest="SELECT DISTINCT section, path FROM (SELECT 'src/' || name || '.java' AS path, unnest(CASE WHEN name LIKE '%Listener' THEN ['contract', 'hot'] WHEN name LIKE '%Service' OR name LIKE '%Repository' THEN ['hot'] WHEN name LIKE 'handle%' THEN []::VARCHAR[] ELSE []::VARCHAR[] END) AS section FROM found_symbols WHERE contains(lower(name), 'bolt'))"))
def tg06_hot_paths(spark, sf_dir):
    f = search_symbols(spark, sf_dir).select(F.concat(F.lit("src/"), "name", F.lit(".java")).alias("path")).distinct()
    return H.hot_paths(f, ["Bolt"])


_TR = "concat('java.lang.IllegalStateException: boom', doc_id, '\\n\\tat com.acme.A.run(A.java:1)\\n\\tat java.util.X.a(X.java:2)\\n\\tat org.springframework.Y.b(Y.java:3)\\n\\tat com.acme.B.run(B.java:4)\\nsame\\nsame\\n\\tat javax.Q.z(Q.java:5)')"


@query("SELECT doc_id AS id, k, l AS line FROM documents, (VALUES (0, ''), (1, chr(9) || 'at com.acme.A.run(A.java:1)'), (2, chr(9) || '... 2 framework frames'), (4, chr(9) || 'at com.acme.B.run(B.java:4)'), (5, 'same'), (7, chr(9) || '... 1 framework frames')) AS v(k, l) WHERE k > 0 UNION ALL SELECT doc_id, 0, 'java.lang.IllegalStateException: boom' || doc_id FROM documents")
def tg09_compressed_traces(spark, sf_dir):
    return X.compressed_trace(read(spark, sf_dir, "documents").selectExpr("doc_id AS id", f"{_TR} AS text"))


_TASK = "CASE doc_id % 8 WHEN 0 THEN 'owasp security audit' WHEN 1 THEN 'review this PR' WHEN 2 THEN 'failing test in CI' WHEN 3 THEN 'rename the field' WHEN 4 THEN 'who calls save' WHEN 5 THEN 'look at src/A.java' WHEN 6 THEN 'explain the flow' ELSE 'rename in the diff' END"


@query("SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'security_audit' WHEN 1 THEN 'review_diff' WHEN 2 THEN 'debug_runtime' WHEN 3 THEN 'refactor_scope' WHEN 4 THEN 'exact_symbol' WHEN 5 THEN 'exact_symbol' WHEN 6 THEN 'broad_flow' ELSE 'review_diff' END AS route FROM documents")
def tg10_routes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", H.route(F.expr(_TASK)).alias("route"))


@query("SELECT doc_id, greatest(ceil(length(text) / CASE lang WHEN 'en' THEN 3.8 WHEN 'de' THEN 4.2 WHEN 'fr' THEN 1.8 ELSE 4.0 END), 1)::BIGINT AS tokens, least(greatest(coalesce(CASE WHEN doc_id % 3 = 0 THEN n_chars END, h), least(1200, h)), h)::BIGINT AS budget FROM (SELECT *, least(CASE WHEN doc_id % 4 = 0 THEN least(8000, 2000) ELSE 8000 END, CASE WHEN doc_id % 5 = 0 THEN greatest(1200, floor(700 * 4 * 0.7::DOUBLE)) ELSE 8000 END) AS h FROM documents)")
def fn_budgets(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "code").when(F.col("lang") == "de", "java").when(F.col("lang") == "fr", "vietnamese").otherwise("none")
    budget = H.output_budget(F.lit(8000), F.when(F.col("doc_id") % 4 == 0, 2000), F.when(F.col("doc_id") % 5 == 0, 700), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")))
    return d.select("doc_id", H.tokens_by_kind(F.col("text"), kind).alias("tokens"), budget.cast("bigint").alias("budget"))


_CTX = "doc_id AS hunk, 'f' AS file, k, CASE WHEN k = 0 THEN ' ' ELSE 'line' || (k + CASE doc_id % 4 WHEN 3 THEN 500 WHEN 2 THEN CASE WHEN k = 1 THEN 0 ELSE 500 END ELSE 0 END) END AS text, k + CASE doc_id % 4 WHEN 0 THEN 0 ELSE 7 END AS new_line, k + CASE doc_id % 4 WHEN 2 THEN 0 WHEN 1 THEN 0 ELSE 9 END AS old_line"


@query("SELECT doc_id AS hunk, CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, doc_id % 4 <> 3 AS safe, CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 3 THEN 'none' ELSE 'old' END AS at FROM documents")
def cardn_line_mapping(spark, sf_dir):
    src = spark.range(1, 100).selectExpr("'f' AS file", "cast(id AS int) AS line", "concat('line', id) AS text")
    ctx = read(spark, sf_dir, "documents").selectExpr("doc_id", "explode(array(0, 1, 2, 3, 4, 5)) AS k").selectExpr(*("doc_id AS hunk", "'f' AS file", "k", "CASE WHEN k = 0 THEN ' ' ELSE concat('line', k + CASE doc_id % 4 WHEN 3 THEN 500 WHEN 2 THEN CASE WHEN k = 1 THEN 0 ELSE 500 END ELSE 0 END) END AS text", "cast(k + CASE doc_id % 4 WHEN 0 THEN 0 ELSE 7 END AS int) AS new_line", "cast(k + CASE doc_id % 4 WHEN 2 THEN 0 WHEN 1 THEN 0 ELSE 9 END AS int) AS old_line"))
    return H.line_mapping(ctx, src)


@query("SELECT 'doc_' || doc_id AS file, doc_id % 4 + 1 AS first, doc_id % 4 + 3 AS last, array_to_string(list_slice(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), (doc_id % 4 + 1)::INT, (doc_id % 4 + 3)::INT), chr(10)) AS text FROM documents WHERE doc_id % 13 = 0 ORDER BY file, first, last LIMIT 20")
def pack_slices(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("file"), "text", "doc_id")
    want = d.filter("doc_id % 13 = 0").selectExpr("file", "cast(doc_id % 4 + 1 AS int) AS first", "cast(doc_id % 4 + 3 AS int) AS last")
    return P.slices(d.select("file", "text"), want).select("file", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "text")


@query(sql("symbols", "deps", "calls", rest="""WITH own AS (SELECT * FROM symbols WHERE file = 'src/7.java'), p AS (SELECT 'classes' AS section, row_number() OVER (ORDER BY line, fq_name) AS place, fq_name AS key, kind AS value FROM own WHERE kind IN ('class', 'interface', 'enum') UNION ALL SELECT 'members', row_number() OVER (ORDER BY line, fq_name), fq_name, kind FROM own WHERE kind IN ('method', 'field')
 UNION ALL SELECT 'imports', row_number() OVER (ORDER BY source), source, 'src/7.java' FROM (SELECT DISTINCT callee AS source FROM calls WHERE file = 'src/7.java') UNION ALL SELECT 'dependencies', row_number() OVER (ORDER BY b), b, 'src/7.java' FROM (SELECT DISTINCT 'src/' || (b % 97) || '.java' AS b FROM deps WHERE a % 97 = 7) UNION ALL SELECT 'dependents', row_number() OVER (ORDER BY a), a, 'src/7.java' FROM (SELECT DISTINCT 'src/' || (a % 97) || '.java' AS a FROM deps WHERE b % 97 = 7) UNION ALL SELECT 'endpoints', row_number() OVER (ORDER BY path, method), path, method FROM (SELECT '/p' || p_partkey AS path, p_type AS method FROM part WHERE p_partkey % 97 = 7))
 SELECT section, place::INT AS place, key, value FROM p WHERE place <= 10 UNION ALL SELECT 'cut', k, s, greatest((SELECT count(*) FROM p WHERE p.section = s) - 10, 0)::VARCHAR FROM (VALUES (1, 'classes'), (2, 'members'), (3, 'imports'), (4, 'dependencies'), (5, 'dependents'), (6, 'endpoints')) AS v(k, s)"""))
def pack_file_summary(spark, sf_dir):
    d = dependencies(spark, sf_dir).selectExpr("concat('src/', a % 97, '.java') AS a", "concat('src/', b % 97, '.java') AS b").distinct()
    e = read(spark, sf_dir, "part").selectExpr("concat('src/', p_partkey % 97, '.java') AS file", "concat('/p', p_partkey) AS path", "p_type AS method")
    return P.file_summary("src/7.java", symbols(spark, sf_dir), calls(spark, sf_dir).selectExpr("file AS path", "callee AS source"), d, e, 10)


_PATCH = "pt AS (SELECT DISTINCT doc_id % 9 AS patch, 'src/' || (doc_id % 97) || '.java' AS path FROM documents WHERE doc_id < 120), fd AS (SELECT DISTINCT 'src/' || (a % 97) || '.java' AS a, 'src/' || (b % 97) || '.java' AS b FROM deps WHERE a % 11 = 0 AND b % 5 = 0), nr AS (SELECT DISTINCT pt.patch, fd.a AS path FROM pt JOIN fd ON fd.b = pt.path WHERE NOT EXISTS (SELECT 1 FROM pt q WHERE q.patch = pt.patch AND q.path = fd.a)), ep AS (SELECT id, 'src/' || (id * 13 % 97) || '.java' AS path FROM symbols WHERE id % 40 = 0)"


@query(sql("symbols", "deps", "calls", rest=f"""WITH {_PATCH}, x AS (SELECT p.patch, count(*) AS n_files, (SELECT count(*) FROM pt q JOIN symbols s ON s.file = q.path WHERE q.patch = p.patch) AS n_symbols, (SELECT count(*) FROM nr WHERE nr.patch = p.patch) AS n_dependents,
 (SELECT count(DISTINCT c.caller) FROM pt q JOIN symbols s ON s.file = q.path JOIN calls c ON c.callee = 'P' || s.id WHERE q.patch = p.patch AND c.tier = 'provider' AND c.line = 1 AND c.file NOT IN (SELECT path FROM pt z WHERE z.patch = p.patch)) AS n_callers, (SELECT count(DISTINCT ep.id) FROM pt q JOIN ep USING (path) WHERE q.patch = p.patch) AS n_endpoints,
 (SELECT count(DISTINCT ep.id) FROM nr JOIN ep USING (path) WHERE nr.patch = p.patch) AS n_impacted, (SELECT count(*) FROM nr WHERE nr.patch = p.patch AND path LIKE '%3.java') AS n_tests FROM pt p GROUP BY p.patch), y AS (SELECT *, n_files + 2 * n_dependents + n_callers + 5 * n_endpoints + 3 * n_impacted + least(n_tests, 5) AS score FROM x)
 SELECT *, CASE WHEN n_endpoints > 0 OR n_dependents >= 10 OR n_callers >= 10 OR score >= 18 THEN 'high' WHEN score >= 5 THEN 'medium' ELSE 'low' END AS level, concat_ws(',', CASE WHEN n_endpoints > 0 THEN 'endpoint-change' END, CASE WHEN n_impacted > 0 THEN 'dependent-endpoint' END, CASE WHEN n_dependents >= 10 OR n_callers >= 10 THEN 'high-fanout' END, CASE WHEN n_tests = 0 THEN 'no-tests-found' END) AS flags FROM y"""))
def pack_patch_impact(spark, sf_dir):
    pt = read(spark, sf_dir, "documents").filter("doc_id < 120").selectExpr("doc_id % 9 AS patch", "concat('src/', doc_id % 97, '.java') AS path")
    fd = dependencies(spark, sf_dir).filter("a % 11 = 0 AND b % 5 = 0").selectExpr("concat('src/', a % 97, '.java') AS a", "concat('src/', b % 97, '.java') AS b").distinct()
    s = symbols(spark, sf_dir)
    ep = s.filter("id % 40 = 0").selectExpr("id", "concat('src/', id * 13 % 97, '.java') AS file")
    tests = spark.range(97).selectExpr("concat('src/', id, '.java') AS path").filter("path LIKE '%3.java'")
    return P.patch_impact(pt, s.select("file", F.concat(F.lit("P"), "id").alias("callee")), fd, calls(spark, sf_dir).filter("tier = 'provider' AND line = 1"), ep, tests)


@query(sql("found_symbols", "endpoints", "calls", rest="""WITH e AS (SELECT e.id, s.file FROM endpoints e JOIN found_symbols s USING (id)), sv AS (SELECT file, array_to_string(list_slice(list_sort(list(DISTINCT name) FILTER (coalesce(framework_role, '') = 'spring:service' OR name LIKE '%Service')), 1, 5), ' ') AS services, array_to_string(list_slice(list_sort(list(DISTINCT name) FILTER (coalesce(framework_role, '') = 'spring:repository' OR name LIKE '%Repository')), 1, 5), ' ') AS repositories FROM found_symbols GROUP BY file),
 c AS (SELECT s.file, k.callee, k.caller, k.line, k.confidence, row_number() OVER (PARTITION BY s.file ORDER BY k.confidence DESC, k.line, k.callee, k.caller) AS rn FROM calls k JOIN found_symbols s ON 'P' || s.id = k.callee WHERE k.tier = 'provider'), m AS (SELECT file, string_agg(callee, ' ' ORDER BY rn) FILTER (rn <= 3) AS calls, count(*) AS n_calls FROM c WHERE rn <= 25 GROUP BY file), t AS (SELECT file, count(DISTINCT caller) AS n_tests FROM c GROUP BY file)
 SELECT e.id, e.file AS handler, coalesce(services, '') AS services, coalesce(repositories, '') AS repositories, m.calls, coalesce(n_calls, 0) AS n_calls, coalesce(n_tests, 0) AS n_tests FROM e LEFT JOIN sv USING (file) LEFT JOIN m USING (file) LEFT JOIN t USING (file)"""))
def pack_endpoints(spark, sf_dir):
    from ..operators.tables import endpoints

    s = search_symbols(spark, sf_dir)
    e = endpoints(spark, sf_dir).join(s.select("id", "file"), "id").select("id", "file")
    c = calls(spark, sf_dir).filter("tier = 'provider'").drop("file").join(s.select(F.concat(F.lit("P"), "id").alias("callee"), "file"), "callee")
    return P.endpoint_packet(e, s, c, c.select("file", F.col("caller").alias("test")))


@query(sql("files", rest="SELECT language, files, symbols, errors, stale, CASE WHEN symbols = 0 THEN 'unindexed' WHEN errors * 10 > files THEN 'degraded' WHEN stale THEN 'stale' ELSE 'ready' END AS state, CASE WHEN symbols = 0 THEN 50 ELSE 100 - CASE WHEN stale THEN 15 ELSE 0 END - CASE WHEN errors * 10 > files THEN 20 ELSE 0 END END AS score FROM (SELECT language, count(*) AS files, count(*) FILTER (role = 'main_source' AND language <> 'es') AS symbols, count(*) FILTER (doc_id % 13 = 0) AS errors, count(*) % 2 = 1 AS stale FROM files GROUP BY language)"))
def pack_status(spark, sf_dir):
    f = files(spark, sf_dir).groupBy("language").agg(F.count(ONE).alias("files"), F.count_if((F.col("role") == "main_source") & (F.col("language") != "es")).alias("symbols"), F.count_if(F.col("doc_id") % 13 == 0).alias("errors"), (F.count(ONE) % 2 == 1).alias("stale"))
    return P.status(f)


@query()
def pack_research(spark, sf_dir):
    """Composed of ft07, ft05, gr11 and ft18, each with SQL of its own; rows only here."""
    s = search_symbols(spark, sf_dir).withColumn("callee_name", F.concat(F.lit("P"), "id"))
    place = lambda end: s.select(F.col("id").alias(end), F.col("file").alias(f"f{end}"))
    d = dependencies(spark, sf_dir).join(place("a"), "a").join(place("b"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    c = calls(spark, sf_dir).withColumn("resolution", F.lit("name-unique"))
    return P.research_pack("how does the red bolt cache work", search_files(spark, sf_dir), s, file_endpoints(spark, sf_dir), d, c)


@query("SELECT p_partkey AS id, list_sort(list_distinct(string_split(replace(p_name, ' ', '_'), '_')))::VARCHAR[] = list_sort(string_split(p_name, ' ')) AS parts, p_partkey % 2 = 0 AS stems FROM part")
def fn_words_and_stems(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    words = F.sort_array(T.word_parts(F.regexp_replace("p_name", " ", "_")))
    stems = T.shares_stem(F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'indexers' ELSE 'callback' END"), "indexing") | T.shares_stem(F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'extract' ELSE 'testament' END"), "test")
    return p.select(F.col("p_partkey").alias("id"), (words == F.sort_array(F.split("p_name", " "))).alias("parts"), stems.alias("stems"))


_ANN = "CASE p_partkey % 9 WHEN 0 THEN array('Override', 'RestController') WHEN 1 THEN array('Path', 'Controller') WHEN 2 THEN array('EnableTransactionManagement') WHEN 3 THEN array('OneToMany', 'JoinColumn') WHEN 4 THEN array('FutureOrPresent') WHEN 5 THEN array('CsrfProtected') WHEN 6 THEN array('Own') WHEN 7 THEN array('Value') ELSE cast(array() AS array<string>) END"


@query("SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'spring:rest-controller' WHEN 1 THEN 'mvc:controller' WHEN 2 THEN 'spring:enable-tx' WHEN 3 THEN 'jakarta:relation' WHEN 4 THEN 'jakarta:validation' WHEN 5 THEN 'mvc:csrf-protected' WHEN 7 THEN 'spring:config-value' END AS role FROM part")
def src07_framework_roles(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), W.framework_role(F.expr(_ANN)).alias("role"))


@query("""SELECT 'C' || (p_partkey % 3) AS class, 'm' || p_partkey AS method, CASE p_partkey % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'ANY' ELSE 'DELETE' END AS verb, CASE p_partkey % 3 WHEN 0 THEN '/api' ELSE '' END || CASE p_partkey % 4 WHEN 0 THEN '/x' || p_partkey WHEN 1 THEN CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '/' END ELSE '/{Paths.ONE}' END AS path,
 CASE WHEN p_partkey % 4 = 2 THEN 'partial' ELSE 'exact' END AS resolution, CASE WHEN p_partkey % 4 = 2 THEN 0.55 ELSE 0.85 END::DOUBLE AS confidence FROM part WHERE p_partkey % 4 <> 3""")
def src07_annotated_endpoints(spark, sf_dir):
    m = read(spark, sf_dir, "part").selectExpr("concat('C', p_partkey % 3) AS class", "concat('m', p_partkey) AS method", "CASE p_partkey % 4 WHEN 0 THEN 'GetMapping' WHEN 1 THEN 'RequestMapping' WHEN 2 THEN 'DeleteMapping' ELSE 'Bean' END AS annotation", "CASE p_partkey % 4 WHEN 0 THEN concat('value = {\"/x', p_partkey, '/\"}') WHEN 2 THEN ' Paths.ONE' END AS argument")
    return W.annotated_endpoints(m, spark.createDataFrame([("C0", "/api/")], "class string, base string"))


_USE = "SELECT 'f' || (l_partkey % 60) AS field, CASE l_linestatus WHEN 'O' THEN 'read' ELSE 'write' END AS access, 'S' || l_suppkey AS method, 'src/' || (l_orderkey % 97) || '.java' AS file, round(1 - l_discount * 5, 4) AS confidence FROM lineitem"


@query(sql("calls", rest=f"""WITH u AS ({_USE}), d AS (SELECT 'f' || (p_partkey % 60) AS field, count(*) AS n_definitions FROM part GROUP BY 1 HAVING field LIKE '%7%'), o AS (SELECT u.* FROM u JOIN d USING (field) WHERE confidence >= 0.5), e AS (SELECT 'src/' || (p_partkey * 7 % 97) || '.java' AS file, count(*) AS n FROM part WHERE p_partkey % 5 = 0 GROUP BY 1)
 SELECT d.field, d.n_definitions, count(*) FILTER (access = 'read') AS n_reads, count(*) FILTER (access = 'write') AS n_writes, count(DISTINCT method) AS n_methods, coalesce((SELECT count(DISTINCT c.caller) FROM calls c WHERE c.caller IN (SELECT method FROM o x WHERE x.field = d.field)), 0) AS n_callers, coalesce((SELECT sum(e.n) FROM e WHERE e.file IN (SELECT file FROM o x WHERE x.field = d.field)), 0)::BIGINT AS n_endpoints, count(DISTINCT file) FILTER (file LIKE '%3.java') AS n_test_files
 FROM d LEFT JOIN o USING (field) GROUP BY d.field, d.n_definitions"""))
def pack_field_impact(spark, sf_dir):
    u = read(spark, sf_dir, "lineitem").selectExpr("concat('f', l_partkey % 60) AS field", "CASE l_linestatus WHEN 'O' THEN 'read' ELSE 'write' END AS access", "concat('S', l_suppkey) AS method", "concat('src/', l_orderkey % 97, '.java') AS file", "round(1 - l_discount * 5, 4) AS confidence")
    f = read(spark, sf_dir, "part").selectExpr("concat('f', p_partkey % 60) AS name", "p_brand AS owner")
    e = read(spark, sf_dir, "part").filter("p_partkey % 5 = 0").selectExpr("concat('src/', p_partkey * 7 % 97, '.java') AS file")
    c = calls(spark, sf_dir).select(F.col("caller").alias("callee"), "caller")
    return P.field_impact(["x.7"], f, u, c, e, F.col("file").endswith("3.java"))


@query("WITH f AS (SELECT 'd' || doc_id AS path, n_chars AS size, doc_id % 10 AS risk FROM documents WHERE doc_id < 150) SELECT path, greatest(floor(coalesce(sum(size) OVER (ORDER BY risk DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 20000), floor((row_number() OVER (ORDER BY risk DESC, path) - 1) / 6))::BIGINT AS batch FROM f")
def review_file_batches(spark, sf_dir):
    f = read(spark, sf_dir, "documents").filter("doc_id < 150").selectExpr("concat('d', doc_id) AS path", "n_chars AS size", "doc_id % 10 AS risk")
    return P.review_batches(f, 20000, 6)


@query("WITH u AS (SELECT user_id || event_type AS id, min(CASE WHEN event_type = 'error' AND user_id % 50 = 1 THEN 'P0' WHEN event_type IN ('click', 'view') THEN 'P1' ELSE 'P2' END) AS priority FROM events GROUP BY 1) SELECT count(*) FILTER (priority = 'P0') AS p0, count(*) FILTER (priority = 'P1') AS p1, count(*) FILTER (priority = 'P2') AS p2, 10 AS batches, 9 AS done, CASE WHEN count(*) FILTER (priority = 'P0') > 0 THEN 1 ELSE 2 END AS exit_code FROM u")
def review_outcome(spark, sf_dir):
    f = read(spark, sf_dir, "events").selectExpr("concat(user_id, event_type) AS id", "CASE WHEN event_type = 'error' AND user_id % 50 = 1 THEN 'P0' WHEN event_type IN ('click', 'view') THEN 'P1' ELSE 'P2' END AS priority")
    b = spark.range(10).toDF("batch")
    return P.review_result(f, b, b.filter("batch <> 4"))


@query(sql("files", rest="WITH c AS (SELECT DISTINCT blob_hash FROM files WHERE doc_id % 3 = 0) SELECT f.blob_hash, min(f.path) AS path, count(*) AS n_files FROM files f WHERE f.blob_hash NOT IN (SELECT blob_hash FROM c) GROUP BY f.blob_hash"))
def snk08_files_to_parse(spark, sf_dir):
    f = files(spark, sf_dir).select("path", "blob_hash", "doc_id")
    cache = f.selectExpr("'syntax' AS provider", "CASE WHEN doc_id % 3 = 0 THEN '2' ELSE '1' END AS version", "blob_hash")
    return N.to_parse(f.select("path", "blob_hash"), cache, "syntax", "2")


@query(sql("files", "found_symbols", "deps", "endpoints", "found_endpoints", rest="""WITH l AS (SELECT language AS key, sum(size) AS v FROM files GROUP BY 1), m AS (SELECT package AS key, count(DISTINCT file) AS v FROM found_symbols GROUP BY 1), e AS (SELECT x.package || ' > ' || y.package AS key, count(*) AS v FROM deps JOIN found_symbols x ON x.id = deps.a JOIN found_symbols y ON y.id = deps.b WHERE x.package <> y.package GROUP BY 1), h AS (SELECT file AS key, count(*) * 3 AS v FROM found_symbols GROUP BY 1),
 p AS (SELECT DISTINCT method || ' ' || path AS key, file AS v, 0 AS p FROM found_endpoints UNION SELECT DISTINCT fq_name, kind, 1 FROM found_symbols WHERE kind = 'method' AND name = 'main' OR kind = 'class' AND name LIKE '%Application')
 SELECT section, place::INT AS place, key, value FROM (SELECT 'languages' AS section, row_number() OVER (ORDER BY v DESC, key) AS place, key, v::VARCHAR AS value FROM l UNION ALL SELECT 'modules', row_number() OVER (ORDER BY v DESC, key), key, v::VARCHAR FROM m UNION ALL SELECT 'module dependencies', row_number() OVER (ORDER BY v DESC, key), key, v::VARCHAR FROM e UNION ALL SELECT 'hotspots', row_number() OVER (ORDER BY v DESC, key), key, v::VARCHAR FROM h UNION ALL SELECT 'entry points', row_number() OVER (ORDER BY p, key, v), key, v FROM p) WHERE place <= 10"""))
def pack_atlas(spark, sf_dir):
    s = search_symbols(spark, sf_dir)
    of = lambda end, name: s.select(F.col("id").alias(end), F.col("package").alias(name))
    e = dependencies(spark, sf_dir).join(of("a", "source"), "a").join(of("b", "target"), "b").filter("source <> target").groupBy("source", "target").agg(F.count(ONE).alias("edge_count"))
    h = s.groupBy(F.col("file").alias("path")).agg((F.count(ONE) * 3).alias("weight"))
    return P.atlas(files(spark, sf_dir), s.select(F.col("file").alias("path"), F.col("package").alias("module")).distinct(), e, h, file_endpoints(spark, sf_dir), s)


_BUILD = "concat('Downloading from x', doc_id, '\\nstart ', doc_id, '\\n\\n[ERROR] bad ', doc_id % 3, '\\n> Task :a UP-TO-DATE\\n[ERROR] bad ', doc_id % 3, '\\nTests run: 3, Failures: 1\\n  at a.B.c(B.java:1)\\nend')"
_LINES = "(VALUES (1, 'start #'), (3, '[ERROR] bad %'), (6, 'Tests run: 3, Failures: 1'), (7, '  at a.B.c(B.java:1)'), (8, 'end')) AS v(k, l)"


@query(f"SELECT doc_id AS id, s AS section, k, replace(replace(l, '#', doc_id::VARCHAR), '%', (doc_id % 3)::VARCHAR) AS line FROM documents, {_LINES}, (VALUES ('kept'), ('first'), ('last')) AS w(s) WHERE s <> 'kept' OR k IN (3, 6, 7)")
def fn_build_digest(spark, sf_dir):
    return X.build_digest(read(spark, sf_dir, "documents").selectExpr("doc_id AS id", f"{_BUILD} AS text"))


@query("SELECT doc_id AS id, 'summary' AS section, k, l AS line FROM documents, (VALUES (3, '[ERROR] bad 0'), (6, 'Tests run: 3, Failures: 1')) AS v(k, l) WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'frames', 7, '  at a.B.c(B.java:1)' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'last', k, replace(l, '#', doc_id::VARCHAR) FROM documents, (VALUES (0, 'Downloading from x#'), (1, 'start #'), (2, ''), (3, '[ERROR] bad 0'), (4, '> Task :a UP-TO-DATE'), (6, 'Tests run: 3, Failures: 1'), (7, '  at a.B.c(B.java:1)'), (8, 'end')) AS v(k, l) WHERE doc_id % 3 = 0")
def fn_error_digest(spark, sf_dir):
    return X.error_digest(read(spark, sf_dir, "documents").filter("doc_id % 3 = 0").selectExpr("doc_id AS id", f"{_BUILD} AS text"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'java-trace' WHEN 1 THEN 'build-log' WHEN 2 THEN 'json-result' WHEN 3 THEN 'error-summary' ELSE 'plain' END AS kind FROM documents")
def fn_log_kinds(spark, sf_dir):
    t = F.expr("CASE doc_id % 5 WHEN 0 THEN concat('a.MyException: x\\n', repeat('\\tat a.B.c(B.java:1)\\n', 3)) WHEN 1 THEN 'mvn -q\\nDownloading from r' WHEN 2 THEN concat('[', repeat('1, ', 90), '2]') WHEN 3 THEN concat('it failed', repeat(' x', 500)) ELSE 'failed' END")
    return read(spark, sf_dir, "documents").select("doc_id", X.log_kind(t).alias("kind"))
