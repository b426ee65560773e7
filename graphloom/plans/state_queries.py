"""Queries of paths, compare-and-set logs, sequential folds, sessions and nested documents, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import certificate as C
from ..operators import dataflow as D
from ..operators import gate as H
from ..operators import graph as G
from ..operators import packets as K
from ..operators import relational as R
from ..operators import versions as V
from ..operators.tables import dependencies, query_log, read, search_symbols, split_columns, sql
from ..sources import frameworks as W
from ..sources import nested as J
from ..sources import types as TY
from ..streaming import folds
from .registry import query


@query(sql("deps", rest="""--recursive WITH walk AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_partkey < 3 UNION SELECT d.b, w.depth + 1 FROM walk w JOIN deps d ON d.a = w.node WHERE w.depth < 3),
 n AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node), tree AS (SELECT y.node, y.depth, min(x.node) AS parent FROM n y LEFT JOIN deps d ON d.b = y.node LEFT JOIN n x ON x.node = d.a AND x.depth = y.depth - 1 GROUP BY y.node, y.depth),
 back AS (SELECT node AS target, depth, parent, [node] AS path FROM tree WHERE node % 7 = 0 UNION ALL SELECT b.target, b.depth, t.parent, list_prepend(t.node, b.path) FROM back b JOIN tree t ON t.node = b.parent)
 SELECT target, depth::INT AS depth, array_to_string(path, '>') AS path FROM back WHERE parent IS NULL"""))
def gr09_flow_paths(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    found = G.flow_paths(dependencies(spark, sf_dir), p.filter("p_partkey < 3").select("p_partkey"), p.filter("p_partkey % 7 = 0").select("p_partkey"), 3)
    return found.select("target", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


_SAVES = "(row_number() OVER (PARTITION BY session ORDER BY ts, id) - 1) {div} 2 + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END"


@query(sql("log", rest=f"""--recursive WITH s AS (SELECT session AS task, ts AS tm, id AS writer, {_SAVES.format(div="//")} AS expected FROM log), o AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY tm, writer) AS n FROM s),
 f AS (SELECT task, n, writer, expected, 0::BIGINT AS version, expected = 0 AS accepted FROM o WHERE n = 1 UNION ALL SELECT o.task, o.n, o.writer, o.expected, f.version + f.accepted::BIGINT, o.expected = f.version + f.accepted::BIGINT FROM f JOIN o ON o.task = f.task AND o.n = f.n + 1)
 SELECT task, writer, expected, version FROM f WHERE NOT accepted"""))
def sm06_conflicts(spark, sf_dir):
    saves = query_log(spark, sf_dir).selectExpr("session AS task", "ts AS at", "id AS writer", f"{_SAVES.format(div='div')} AS expected")
    return V.conflicts(saves).select("task", "writer", "expected", "version")


# 20,000 characters a source, in slices of 3,200 at most: recursive SQL takes them one by one
@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE n_chars > 0),
 b AS (SELECT source, 0 AS n, NULL::BIGINT AS doc_id, 0::BIGINT AS taken, NULL::BIGINT AS whole, 0::BIGINT AS used, true AS going FROM o WHERE n = 1
  UNION ALL SELECT o.source, o.n, o.doc_id, least(o.n_chars, 6400, 20000 - b.used), o.n_chars, b.used + least(o.n_chars, 6400, 20000 - b.used), true FROM b JOIN o ON o.source = b.source AND o.n = b.n + 1 WHERE b.n < 5 AND 20000 - b.used >= 500)
 SELECT source, doc_id, n::INT AS place, taken, taken < whole AS truncated, used FROM b WHERE n > 0""")
def wn06_sequential_budget(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return R.spent_budget(d, ["source"], [F.desc("n_chars"), F.col("doc_id")], "n_chars", 20000, each=6400).select("source", "doc_id", "place", "taken", "truncated", "used")


_ORDER_JSON = ("WITH t AS (SELECT l_orderkey AS id, '{{\"id\":' || l_orderkey || ',\"status\":\"' || CASE l_orderkey % 3 WHEN 0 THEN 'failed' ELSE 'ok' END || '\",\"items\":[' || {join} || '],\"more\":' || CASE l_orderkey % 4 WHEN 0 THEN '[[1,[2]],[]]' WHEN 1 THEN 'null' ELSE '{{\"a\":{{\"b\":{{\"c\":-7}}}}}}' END || '}}' AS body FROM "
               "(SELECT l_orderkey, '{{\"part\":' || l_partkey || ',\"flags\":[\"' || l_returnflag || '\",\"' || l_linestatus || '\"],\"none\":null,\"open\":' || CASE WHEN l_linenumber % 2 = 0 THEN 'true' ELSE 'false' END || '}}' AS x FROM lineitem) GROUP BY l_orderkey)")


def _orders(spark, sf_dir):
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(_ORDER_JSON.format(join="array_join(array_sort(collect_list(x)), ',')") + " SELECT * FROM t")


_TREE = _ORDER_JSON.format(join="string_agg(x, ',' ORDER BY x)") + ", j AS (SELECT t.id, w.fullkey AS path, w.type, w.value, w.atom FROM t, json_tree(t.body::JSON) w)"


@query(_TREE + """ SELECT id, path, CASE WHEN type IN ('BIGINT', 'UBIGINT') THEN 'bigint' WHEN type = 'VARCHAR' THEN 'string' ELSE lower(type) END AS kind,
 CASE type WHEN 'ARRAY' THEN json_array_length(value)::VARCHAR WHEN 'NULL' THEN 'null' ELSE atom ->> '$' END AS value, 0 AS left_out FROM j WHERE type <> 'OBJECT'""")
def src09_json_paths(spark, sf_dir):
    return J.json_paths(_orders(spark, sf_dir), "id", "body")


@query(_TREE + """, k AS (SELECT id, path, path || CASE type WHEN 'ARRAY' THEN '.length=' || json_array_length(value) WHEN 'NULL' THEN '=null' ELSE '=' || (atom ->> '$') END AS line, CASE WHEN type = 'ARRAY' THEN greatest(json_array_length(value)::BIGINT - 2, 0) ELSE 0 END AS left_out
 FROM j WHERE type <> 'OBJECT' AND NOT regexp_matches(path, '\\[([2-9]|[0-9][0-9]+)\\]')), s AS (SELECT *, regexp_matches(line, '(?i)error|exception|failure|failed|warning|status|message|reason') AS signal FROM k),
 c AS (SELECT id, bool_or(signal) AS a, sum(left_out) AS elements FROM s GROUP BY id), r AS (SELECT s.id, s.path, s.line, row_number() OVER (PARTITION BY s.id ORDER BY s.path) AS rn FROM s JOIN c USING (id) WHERE s.signal OR NOT c.a)
 SELECT id, string_agg(line, chr(10) ORDER BY rn) FILTER (rn <= 3) AS lines, count(*) AS n_fields, (greatest(count(*) - 3, 0) + any_value(elements))::BIGINT AS left_out FROM r JOIN c USING (id) GROUP BY id""")
def fn_json_digest(spark, sf_dir):
    return J.json_digest(_orders(spark, sf_dir), "id", "body", fields=3, items=2)


_EVIDENCE = "concat('w', session % 20) AS server, {ms} AS ms, id, concat('s', session) AS session, CASE WHEN id % 10 < 8 THEN 'one' ELSE concat('at', id {div} 100) END AS snapshot, concat(tool, floor(duration_ms)::BIGINT % 5) AS evidence"


@query(sql("log", rest=f"""--recursive WITH e AS (SELECT {_EVIDENCE.format(ms="epoch_ms(ts)", div="//")} FROM log), o AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY ms, id) AS n FROM e),
 w AS (SELECT server, n, id, [session] AS kept, true AS fresh FROM o WHERE n = 1 UNION ALL SELECT o.server, o.n, o.id, CASE WHEN list_contains(w.kept, o.session) THEN w.kept WHEN len(w.kept) >= 4 THEN list_append(w.kept[2:], o.session) ELSE list_append(w.kept, o.session) END, NOT list_contains(w.kept, o.session) FROM w JOIN o ON o.server = w.server AND o.n = w.n + 1),
 f AS (SELECT o.*, w.fresh OR lag(o.snapshot) OVER s <> o.snapshot AS anew FROM o JOIN w ON w.id = o.id WINDOW s AS (PARTITION BY o.server, o.session ORDER BY o.n)), g AS (SELECT *, sum(CASE WHEN anew THEN 1 ELSE 0 END) OVER (PARTITION BY server, session ORDER BY n) AS life FROM f)
 SELECT server, id, row_number() OVER (PARTITION BY server, session, life, evidence ORDER BY n) > 1 AS reused FROM g"""))
def sm05_sessions_kept(spark, sf_dir):
    e = query_log(spark, sf_dir).selectExpr("concat('w', session % 20) AS server", "unix_millis(cast(ts AS timestamp)) AS ms", "id", "concat('s', session) AS session", "CASE WHEN id % 10 < 8 THEN 'one' ELSE concat('at', id div 100) END AS snapshot", "concat(tool, cast(duration_ms AS bigint) % 5) AS evidence")
    return folds.folded(e, folds.sessions(4))


_REVIEW = "concat('r', user_id % 30) AS review, {ms} AS ms, event_id AS id, CASE WHEN event_type IN ('click', 'view') THEN 'open' ELSE 'batch' END AS event, CASE WHEN event_id % 17 <> 3 THEN concat('f', event_id % 17) END AS path, CASE event_id % 17 WHEN 4 THEN 'deleted' WHEN 5 THEN 'added' ELSE 'modified' END AS status, CAST(event_id % 4 - 1 AS INT) AS hunks, event_id % 5 <> 0 AS resolved, event_id % 3 <> 0 AS complete, event_id % 11 = 0 AS failed"


@query(f"""WITH e AS (SELECT * REPLACE (coalesce(path, '<unparsed-diff-block>') AS path) FROM (SELECT {_REVIEW.format(ms="epoch_ms(ts)")} FROM events)), o AS (SELECT review, path, arg_min(status, (ms, id)) AS status, min((ms, id)) AS at, sum(greatest(hunks, 0)) AS hunks FROM e WHERE event = 'open' GROUP BY ALL),
 b AS (SELECT e.*, o.status AS was, row_number() OVER (PARTITION BY e.review, e.path ORDER BY e.ms DESC, e.id DESC) AS rn, (SELECT sum(greatest(x.hunks, 0)) FROM e x WHERE x.event = 'open' AND x.review = e.review AND x.path = e.path AND (x.ms, x.id) < (e.ms, e.id)) AS so_far FROM e JOIN o ON o.review = e.review AND o.path = e.path WHERE e.event = 'batch' AND (e.ms, e.id) > o.at),
 l AS (SELECT o.review, o.path, o.status, o.hunks, b.rn IS NOT NULL AND NOT b.failed AND b.resolved AND o.status <> 'deleted' AS res, b.rn IS NOT NULL AND NOT b.failed AND (b.complete OR (b.so_far = 0 AND (b.resolved OR o.status = 'deleted'))) AS done FROM o LEFT JOIN b ON b.review = o.review AND b.path = o.path AND b.rn = 1)
 SELECT review, bool_and(done) AS complete, true AS settled, count(*) FILTER (status <> 'deleted')::INT AS eligible, count(*) FILTER (res)::INT AS resolved, sum(hunks)::INT AS hunks, coalesce(sum(hunks) FILTER (done), 0)::INT AS reviewed_hunks, count(*) FILTER (NOT done)::INT AS omitted FROM l GROUP BY review""")
def review_manifests(spark, sf_dir):
    e = read(spark, sf_dir, "events").selectExpr(*split_columns(_REVIEW.format(ms="unix_millis(cast(ts AS timestamp))")))
    return folds.last_coverage(folds.folded(e, folds.review(), end=1 << 52)).drop("n", "ms")


@query(sql("found_symbols", rest="""WITH f AS (SELECT DISTINCT file, name, l_suppkey % 9 AS k FROM found_symbols JOIN lineitem ON l_partkey = id WHERE kind = 'class'), c AS (SELECT file, name, min(line) AS line, max(id % 6) AS a FROM found_symbols WHERE kind = 'class' GROUP BY ALL),
 h AS (SELECT *, CASE a WHEN 0 THEN ['Data'] WHEN 1 THEN ['Builder', 'Log'] WHEN 2 THEN ['Getter', 'With'] WHEN 3 THEN ['Value', 'ToString'] WHEN 4 THEN ['Setter'] ELSE ['Entity'] END AS ann FROM c),
 m AS (SELECT *, unnest([('log', 'field', 'lombok:logger', true, a = 1), ('builder', 'method', 'lombok:builder', true, a = 1), ('build', 'method', 'lombok:builder', false, a = 1), ('toBuilder', 'method', 'lombok:builder', false, a = 1), ('equals', 'method', 'lombok:equals-hashcode', false, a IN (0, 3)), ('hashCode', 'method', 'lombok:equals-hashcode', false, a IN (0, 3)), ('toString', 'method', 'lombok:to-string', false, a IN (0, 3)), (name, 'method', 'lombok:constructor', false, a IN (0, 3))]) AS x FROM h),
 g AS (SELECT h.file, h.name, f.k AS line, f.k, unnest([('get', 'lombok:getter', a IN (0, 2, 3)), ('set', 'lombok:setter', a IN (0, 4) AND f.k <> 2), ('with', 'lombok:with', a = 2)]) AS x FROM f JOIN h USING (file, name))
 SELECT file, name AS class, x[1] AS name, x[2] AS kind, x[3] AS role, line, x[4] AS is_static FROM m WHERE x[5] UNION ALL SELECT file, name, x[1] || 'Field' || k, 'method', x[2], line, false FROM g WHERE x[3]"""))
def src07_lombok_members(spark, sf_dir):
    s = search_symbols(spark, sf_dir).filter("kind = 'class'")
    c = s.groupBy("file", F.col("name").alias("class")).agg(F.min("line").alias("line"), F.max(F.col("id") % 6).alias("a"))
    c = c.withColumn("annotations", F.expr("CASE a WHEN 0 THEN array('Data') WHEN 1 THEN array('Builder', 'Log') WHEN 2 THEN array('Getter', 'With') WHEN 3 THEN array('Value', 'ToString') WHEN 4 THEN array('Setter') ELSE array('Entity') END"))
    f = s.join(read(spark, sf_dir, "lineitem").selectExpr("l_partkey AS id", "l_suppkey % 9 AS k"), "id").selectExpr("file", "name AS class", "concat('field', k) AS field", "k AS line", "k = 2 AS is_static").distinct()
    return W.lombok_members(c, f)


_PAGE = "html || ' ' || CASE page_id % 5 WHEN 0 THEN 'GET ' || regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) WHEN 1 THEN 'Find OrderService.find in C:/work/Page' || page_id || '.java' WHEN 2 THEN 'src/main/a.ts and /api/v1/{id}' ELSE url END"


@query(rf"""WITH r AS (SELECT page_id AS id, {_PAGE} AS t FROM pages), s AS (SELECT id, t, regexp_extract_all(t, '[^/]{{0,24}}/[A-Za-z0-9_{{}}:$.-][A-Za-z0-9_{{}}:$/.-]*') AS m FROM r), u AS (SELECT id, t, unnest(m) AS m, unnest(range(len(m))) AS k FROM s),
 p AS (SELECT id, t, k, split_part(m, '/', 1) AS before, regexp_replace(regexp_extract(m, '/[^\n]*$'), '[),.;:]+$', '') AS path FROM u), q AS (SELECT *, regexp_extract(path, '^/+([^/]*)', 1) AS head FROM p WHERE length(path) >= 2),
 c AS (SELECT id, path, k, 120 * regexp_matches(before, '(?i)\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s*$')::INT + 80 * regexp_matches(path, '(?i)^/(?:api|apis|ws|rest|v\d+|actuator|health|metrics|graphql)(?:/|$)')::INT + 35 * (contains(path, '{{') OR contains(path, '}}'))::INT + 20 * (len(list_filter(string_split(path, '/'), lambda x: x <> '')) >= 2)::INT
  + 15 * regexp_matches(t, '(?i)\b(api|endpoint|route|rest|http|handler|controller|request|response)\b')::INT - 120 * regexp_matches(path, '(?i)\.(?:java|kt|scala|ts|tsx|js|jsx|py|xml|json|ya?ml|md|txt|class)$')::INT - 90 * (lower(head) IN ('user', 'users', 'home', 'personal', 'project', 'projects', 'workspace', 'workspaces', 'src', 'main', 'test', 'tests', 'java', 'com', 'org', 'net', 'io', 'd'))::INT - 70 * regexp_matches(before, '[A-Z]:$')::INT AS points FROM q),
 b AS (SELECT id, path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY points DESC, length(path) DESC, k) AS rn FROM c) WHERE rn = 1 AND points >= 15)
 SELECT r.id, b.path AS endpoint, len(list_filter(list_distinct(regexp_extract_all(t, '\b[A-Z][A-Za-z0-9_$]{{3,}}\b')), lambda x: x NOT IN ('Find', 'Task', 'Question', 'Feature', 'Implementation', 'Context', 'Callers', 'Likely', 'Tests', 'Test', 'The', 'This', 'That', 'With', 'Read', 'Only', 'Return', 'Current', 'Behavior', 'Proposed', 'Acceptance', 'Criteria', 'Edge', 'Cases', 'Validation', 'Commands', 'Trace', 'Implement', 'Check', 'Show', 'List', 'When', 'What', 'Which', 'Using', 'Given', 'Through', 'Create', 'Update', 'Delete', 'Search', 'Load', 'Save', 'Build')))::INT AS n_classes FROM r LEFT JOIN b USING (id)""")
def fn_explicit_names(spark, sf_dir):
    p = read(spark, sf_dir, "pages").selectExpr("page_id AS id", f"{_PAGE} AS text")
    return H.explicit_names(p).select("id", "endpoint", F.size("classes").alias("n_classes"))


_NAMES = ("unitPrice", "alpha", "quantity", "tax_rate", "beta", "rawScore", "gamma", "lineTotal", "limitCheck", "timeWindow", "forecastSum", "delta")
_T = "l_partkey % 12"
_A, _B = "l_suppkey % ({t})".format(t=_T), "(l_linenumber * 5 + l_partkey) % ({t})".format(t=_T)


_DUCK = "list_extract(['" + "', '".join(_NAMES) + "'], ({} + 1)::INT)"
_FLOW = f"""WITH RECURSIVE x AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'src/test/F' ELSE 'src/main/F' END || l_orderkey AS file, {_T} AS t, l_linenumber % 3 AS form, CASE WHEN {_T} > 0 THEN {_A} END AS a, CASE WHEN {_T} > 0 THEN {_B} END AS b FROM lineitem),
 asg AS (SELECT * FROM x WHERE form <> 2), e AS (SELECT DISTINCT file, a, t AS b FROM asg WHERE a IS NOT NULL UNION SELECT file, b, t FROM asg WHERE b IS NOT NULL AND form = 0),
 o AS (SELECT DISTINCT file, t AS output FROM asg WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.file = asg.file AND e.a = asg.t)),
 sl AS (SELECT file, output, output AS node FROM o UNION SELECT sl.file, sl.output, e.a FROM sl JOIN e ON e.file = sl.file AND e.b = sl.node),
 h AS (SELECT DISTINCT file, output, CASE WHEN output = 5 THEN 'score_or_ranking' WHEN output = 8 THEN 'threshold_or_validation_decision' WHEN output = 2 THEN 'quantity_or_capacity' WHEN output IN (0, 3, 7) THEN 'amount_or_total' WHEN output = 9 THEN 'time_or_duration' WHEN output = 10 THEN 'allocation_or_forecast' WHEN file LIKE 'src/main/%' THEN 'unknown_runtime_calculation_sink' END AS grp FROM sl WHERE node IN (0, 1)),
 n AS (SELECT grp, {_DUCK.format("output")} AS name, count(*) AS c FROM h WHERE grp IS NOT NULL GROUP BY ALL)"""


@query(_FLOW + """ SELECT grp AS "group", CASE grp WHEN 'unknown_runtime_calculation_sink' THEN 'unknown' WHEN 'quantity_or_capacity' THEN 'high' WHEN 'time_or_duration' THEN 'high' WHEN 'allocation_or_forecast' THEN 'medium' ELSE 'critical' END AS risk, sum(c)::BIGINT AS n,
 (SELECT string_agg(name, ' ' ORDER BY name) FROM (SELECT name FROM n m WHERE m.grp = n.grp ORDER BY name LIMIT 3)) AS names,
 'boundary values, zero/null/negative values' || CASE grp WHEN 'amount_or_total' THEN ', precision and rounding' || CASE WHEN bool_or(name = 'unitPrice') THEN ', unit conversion' ELSE '' END WHEN 'quantity_or_capacity' THEN ', unit conversion' WHEN 'score_or_ranking' THEN ', ordering or ranking stability' WHEN 'threshold_or_validation_decision' THEN ', threshold inclusivity' WHEN 'time_or_duration' THEN ', time-window boundary behavior' ELSE '' END AS obligations FROM n GROUP BY grp""")
def calc_impact(spark, sf_dir):
    pick = "element_at(array('" + "', '".join(_NAMES) + "'), cast({} + 1 AS int))"
    right = f"CASE WHEN {_T} = 0 THEN '3' ELSE {{}} END"
    a, b = right.format(pick.format(_A)), right.format(pick.format(_B))
    lines = read(spark, sf_dir, "lineitem").selectExpr(
        "concat(CASE WHEN l_orderkey % 5 = 0 THEN 'src/test/F' ELSE 'src/main/F' END, l_orderkey) AS file", "l_linenumber AS line",
        f"CASE l_linenumber % 3 WHEN 0 THEN concat('final Map<String, Double> ', {pick.format(_T)}, ' = ', {a}, ' * this.field(', {b}, '); // alpha = beta') WHEN 1 THEN concat('  ', {pick.format(_T)}, ' += ', {a}, '.value + f(\"alpha\")') ELSE concat('if (', {pick.format(_T)}, ' == ', {a}, ') return;') END AS text")
    assigned = D.assignments(lines)
    changed = assigned.select("file", F.explode(F.concat("uses", F.array("target"))).alias("name")).filter("name in ('unitPrice', 'alpha')").distinct()
    return D.calculation_impact(assigned, changed, depth=12)


_SECTION = "CASE doc_id % 11 WHEN 0 THEN 'symbols' WHEN 1 THEN 'files' WHEN 2 THEN 'tests' WHEN 3 THEN 'evidence' WHEN 4 THEN 'call_edges' WHEN 5 THEN 'edit_ranges' ELSE 'other' END"
_RUBRIC = ("handler", "mode_selection", "edit_ranges", "tests", "risks", "validation", "files", "evidence", "the_con", "zzz_qqq", "in", "heed_xqx")


_COVERED = f"""WITH d AS (SELECT source || '/' || lang || (doc_id % 7) AS packet, {_SECTION} AS section, lower(text) AS t FROM documents), p AS (SELECT packet, string_agg(t, chr(10)) AS hay, count(*) FILTER (section = 'evidence') AS n, list(DISTINCT section) AS s FROM d GROUP BY packet),
 k AS (SELECT packet, hay, n, s, unnest({list(_RUBRIC)!r}) AS key FROM p), w AS (SELECT *, CASE key WHEN 'mode_selection' THEN ['mode', 'selection'] WHEN 'tests' THEN ['test'] WHEN 'risks' THEN ['risk', 'finding'] WHEN 'validation' THEN ['validation', 'command', 'test'] WHEN 'the_con' THEN ['the', 'con'] WHEN 'zzz_qqq' THEN ['zzz', 'qqq'] WHEN 'heed_xqx' THEN ['heed', 'xqx'] ELSE [] END AS a FROM k),
 h AS (SELECT *, len(list_filter(a, lambda x: contains(hay, x))) AS f FROM w), c AS (SELECT packet, key, CASE key WHEN 'handler' THEN CASE WHEN list_has_any(s, ['symbols', 'endpoints']) THEN 'covered' WHEN n > 0 THEN 'partial' ELSE 'missing' END WHEN 'mode_selection' THEN CASE WHEN f = 2 OR list_contains(s, 'call_edges') THEN 'covered' WHEN n > 1 THEN 'partial' ELSE 'missing' END
  WHEN 'edit_ranges' THEN CASE WHEN list_contains(s, 'edit_ranges') THEN 'covered' ELSE 'missing' END WHEN 'tests' THEN CASE WHEN list_contains(s, 'tests') THEN 'covered' WHEN f > 0 THEN 'partial' ELSE 'missing' END WHEN 'risks' THEN CASE WHEN f > 0 THEN 'covered' ELSE 'partial' END WHEN 'validation' THEN CASE WHEN f > 0 THEN 'covered' ELSE 'partial' END
  WHEN 'files' THEN CASE WHEN list_contains(s, 'files') THEN 'covered' ELSE 'missing' END WHEN 'evidence' THEN CASE WHEN n > 0 THEN 'covered' ELSE 'missing' END WHEN 'in' THEN CASE WHEN n > 0 THEN 'covered' ELSE 'missing' END ELSE CASE WHEN f = 2 THEN 'covered' WHEN f > 0 OR n > 2 THEN 'partial' ELSE 'missing' END END AS status FROM h)"""


@query(_COVERED + """,
 g AS (SELECT packet, count(*) FILTER (status = 'covered') AS n_covered, count(*) FILTER (status = 'partial') AS n_partial, count(*) FILTER (status = 'missing') AS n_missing, string_agg(key, ' ' ORDER BY key) FILTER (status = 'missing') AS m, string_agg(key, ' ' ORDER BY key) FILTER (status = 'partial') AS p FROM c GROUP BY packet)
 SELECT packet, n_missing + n_partial = 0 AS answerable, n_covered, n_partial, n_missing, CASE WHEN n_missing > 0 THEN m WHEN n_partial > 0 THEN p ELSE '' END AS follow_up FROM g""")
def cardo_certificate(spark, sf_dir):
    return C.certificate(_covered(spark, sf_dir))


@query(_COVERED + " SELECT packet, key, status FROM c")
def cardo_evidence_coverage(spark, sf_dir):
    return _covered(spark, sf_dir).select("packet", "key", "status")


def _covered(spark, sf_dir):
    d = read(spark, sf_dir, "documents").selectExpr("concat(source, '/', lang, doc_id % 7) AS packet", f"{_SECTION} AS section", "text")
    rubric = d.select("packet").distinct().select("packet", F.explode(F.array(*map(F.lit, _RUBRIC))).alias("key"))
    return C.coverage(rubric, d)


# a class an order: a field, and for each line a method whose parameter an inner block hides
@query("""WITH r AS (SELECT 'C' || l_orderkey AS file, l_orderkey AS k, l_suppkey AS s, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem))
 SELECT file, (5 * n - 2)::INT AS line, 'x' AS receiver, 'A' || (s % 7) AS type FROM r UNION ALL SELECT file, 5 * n, 'x', 'B' || (p % 5) FROM r UNION ALL SELECT file, 5 * n, 'f', 'F' || (k % 3) FROM r""")
def src07_typed_receivers(spark, sf_dir):
    # keys are gathered by order in one shuffle; texts are made of them where they are read
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("ms"))
    method = lambda x: F.concat(F.lit("  void m(final A"), x["l_suppkey"] % 7, F.lit(" x) { // B x = {\n    x.go();\n    if (y) { List<B> z = null; B"), x["l_partkey"] % 5, F.lit(' x = z;\n      x.go("{"); f.go(); }\n  }'))
    texts = rows.select("l_orderkey", F.array_join(F.transform("ms", method), "\n").alias("b")).select(F.concat(F.lit("C"), "l_orderkey").alias("file"), F.concat(F.expr("concat('class C { F', l_orderkey % 3, ' f;\n')"), "b", F.lit("\n}")).alias("text"))
    used = TY.code_lines(texts).select("file", "line", F.explode(F.regexp_extract_all("code", F.lit(r"(\w+)\.go\("), F.lit(1))).alias("receiver"))
    return TY.receiver_types(used, TY.typed_names(texts, "java")).select("file", "line", "receiver", "type")


_STATEMENTS = "SELECT DISTINCT concat('m.Mapper', p_partkey % 40) AS namespace, concat('q', p_size % 25) AS id, CASE p_size % 2 WHEN 0 THEN 'select' ELSE 'insert' END AS kind FROM part"
_MAPPERS = "SELECT DISTINCT concat('m.Mapper', p_partkey % 45) AS owner, concat('q', p_size % 30) AS name, concat('m.Mapper', p_partkey % 45, '.q', p_size % 30) AS fq_name FROM part"
_RUNS = "SELECT DISTINCT concat(CASE l_linenumber % 3 WHEN 0 THEN 'm.' ELSE '' END, 'Mapper', l_partkey % 50, '.q', l_suppkey % 35) AS callee, concat('S', l_suppkey) AS caller, concat('src/', l_orderkey % 97, '.java') AS file, cast(l_linenumber AS bigint) AS line FROM lineitem"
_MAPPED = f"WITH s AS ({_STATEMENTS}), m AS ({_MAPPERS}), c AS ({_RUNS})"


def _mapped(spark, sf_dir):
    read(spark, sf_dir, "part").createOrReplaceTempView("part")
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(_STATEMENTS), spark.sql(_MAPPERS), spark.sql(_RUNS)


@query(_MAPPED + """, j AS (SELECT s.*, m.fq_name AS method FROM s LEFT JOIN m ON m.owner = s.namespace AND m.name = s.id)
 SELECT DISTINCT j.namespace, j.id, j.kind, j.method, c.caller, c.file, c.line FROM j LEFT JOIN c ON j.method IS NOT NULL AND (c.callee = j.method OR 'm.' || c.callee = j.method)""")
def packet_mapper_flow(spark, sf_dir):
    return K.mapper_flow(*_mapped(spark, sf_dir))


@query(_MAPPED + " SELECT 'statement without method' AS gap, namespace, id FROM (SELECT DISTINCT namespace, id FROM s) x WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.owner = x.namespace AND m.name = x.id) UNION ALL SELECT 'method without statement', owner, name FROM m WHERE owner IN (SELECT namespace FROM s) AND NOT EXISTS (SELECT 1 FROM s WHERE s.namespace = m.owner AND s.id = m.name)")
def packet_mapper_gaps(spark, sf_dir):
    return K.mapper_gaps(*_mapped(spark, sf_dir)[:2])


_PLAN = "SELECT DISTINCT concat('t', p_partkey % 20) AS task, CASE p_partkey % 3 WHEN 0 THEN concat('src/', p_size % 7, '/') ELSE concat('src/', p_size % 9, '/f', p_partkey % 15) END AS path, CASE p_partkey % 3 WHEN 0 THEN 'allowed' WHEN 1 THEN 'required' ELSE 'frozen' END AS part FROM part"
_CHANGED = "SELECT DISTINCT concat('t', l_suppkey % 22) AS task, concat(CASE WHEN l_linenumber = 7 THEN 'test/f' ELSE concat('src/', l_partkey % 9, '/f') END, l_orderkey % 15) AS path FROM lineitem"
_IMPORTED = "SELECT DISTINCT concat('test/f', l_orderkey % 11) AS a, concat('src/', l_suppkey % 8, '/f', l_partkey % 13) AS b FROM lineitem"


@query(f"""WITH p AS ({_PLAN}), c AS ({_CHANGED}), e AS ({_IMPORTED}), t AS (SELECT DISTINCT path FROM c WHERE path LIKE 'test/%')
 SELECT task, 'out of scope' AS invariant, path FROM c WHERE task IN (SELECT task FROM p WHERE part = 'allowed') AND NOT EXISTS (SELECT 1 FROM p WHERE p.task = c.task AND p.part = 'allowed' AND starts_with(c.path, p.path))
 UNION ALL SELECT task, 'required but unchanged', path FROM p WHERE part = 'required' AND NOT EXISTS (SELECT 1 FROM c WHERE c.task = p.task AND c.path = p.path)
 UNION ALL SELECT task, 'frozen but changed', path FROM c WHERE EXISTS (SELECT 1 FROM p WHERE p.task = c.task AND p.part = 'frozen' AND p.path = c.path)
 UNION ALL SELECT task, 'no test imports it', path FROM c WHERE path NOT IN (SELECT path FROM t) AND path NOT IN (SELECT b FROM e WHERE a IN (SELECT path FROM t))""")
def packet_scope_breaks(spark, sf_dir):
    _mapped(spark, sf_dir)
    changed = spark.sql(_CHANGED)
    return K.scope_breaks(spark.sql(_PLAN), changed, spark.sql(_IMPORTED), changed.filter("path LIKE 'test/%'").select("path").distinct())
