"""Queries of symbol, file and mixed search, intents, concepts and call scores, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking as K
from ..operators import relational as R
from ..operators.tables import file_endpoints, read, search_files, search_symbols, sql
from .registry import query

ROLE_POINTS = "CASE role WHEN 'main_source' THEN 10 WHEN 'test_source' THEN -8 WHEN 'mock_source' THEN -10 WHEN 'resource_config' THEN -12 WHEN 'build_config' THEN -15 WHEN 'generated' THEN -12 ELSE 0 END"
KIND_POINTS = "CASE WHEN kind IN ('class','interface','enum') THEN 18 WHEN kind = 'method' THEN 10 WHEN kind = 'field' THEN 5 ELSE 0 END"
FILE_RANK = "CASE role WHEN 'main_source' THEN 100 WHEN 'resource_config' THEN 80 WHEN 'build_config' THEN 75 WHEN 'test_source' THEN 60 WHEN 'mock_source' THEN 45 ELSE 30 END"


_TEXT = "concat_ws(' ', lower(name), lower(fq_name), lower(file), lower(package), lower(coalesce(framework_role, '')), lower(signature), lower(array_to_string(annotations, ' ')), db_name)"


def _small(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


def _symbol_sql(text: str, tokens: list[str], concepts: str = "0", entry: str = "0", lone: str = "false") -> str:
    """Scores of symbols by the definition, one level of select at a time."""
    low, small, n = text.lower(), "".join(c for c in text.lower() if c.isalnum()), len(tokens)
    hit = " + ".join(f"(contains(t, '{x}') OR contains(c, '{x}'))::INT" for x in tokens)
    named = " + ".join(f"(contains(lower(name), '{x}') OR contains({_small('name')}, '{x}'))::INT" for x in tokens)
    member = f"(lower(fq_name) = '{low}' OR ends_with(lower(fq_name), '.{low}'))" if "." in low else "false"
    return f"""WITH h AS (SELECT *, {_TEXT} AS t, concat_ws(' ', {_small('name')}, {_small('fq_name')}, {_small('file')}, {_small('db_name')}) AS c FROM found_symbols),
 m AS (SELECT *, ({hit})::INT AS n_matched, ({named})::INT AS named, ({concepts})::INT AS concept, ({entry})::INT AS intent, contains(lower(name), '{low}') OR contains(lower(fq_name), '{low}') AS phrase FROM h),
 p AS (SELECT *, db_name <> '' AND (db_name = '{low}' OR {_small('db_name')} = '{small}' OR (length(db_name) >= 5 AND contains(db_name, '_') AND regexp_matches('{low}', '(^|[^a-z0-9_])' || db_name || '([^a-z0-9_]|$)'))) AS physical FROM m),
 s AS (SELECT *, (CASE WHEN physical AND lower(name) <> '{low}' THEN 122 WHEN {member} AND lower(name) <> '{low}' THEN 135 WHEN lower(name) = '{low}' OR lower(fq_name) = '{low}' THEN 120
  WHEN {_small('name')} = '{small}' OR ends_with({_small('fq_name')}, '{small}') THEN 112 WHEN phrase THEN 98 WHEN n_matched = {n} AND named = {n} THEN 88 WHEN n_matched = {n} THEN 74
  WHEN n_matched > 0 THEN 40 + floor(n_matched / {n} * 30 + 0.5) + CASE WHEN named > 0 THEN 8 ELSE 0 END ELSE 0 END
  + CASE WHEN intent > 0 THEN intent WHEN {lone} THEN -35 ELSE 0 END - CASE WHEN synthetic THEN 60 ELSE 0 END + CASE WHEN named > 0 OR phrase THEN {KIND_POINTS} ELSE 0 END + {ROLE_POINTS}
  + least(floor(ln(1 + coalesce(in_degree, 0)) * 6 + 0.5), 15) + concept + CASE WHEN concept > 0 AND n_matched = 0 AND NOT phrase THEN {KIND_POINTS} ELSE 0 END)::BIGINT AS score FROM p WHERE n_matched > 0 OR phrase OR intent > 0 OR concept > 0)"""


_AUTH = "CASE WHEN regexp_matches(lower(name), '(authoriz|authentic|\\bauth\\b|security|secured|login|logout|permission|principal|credential)') THEN 72 WHEN lower(coalesce(framework_role,'')) = 'spring:security' THEN 34 ELSE 0 END"
_CACHE = "CASE WHEN regexp_matches(lower(name), '(cache|caching|evict|memoiz)') THEN 72 WHEN list_contains(annotations, 'Cacheable') THEN 48 WHEN coalesce(framework_role,'') = 'spring:cacheable' THEN 34 ELSE 0 END"
_TX = "CASE WHEN regexp_matches(lower(name), '(transaction|\\bcommit\\b|rollback)') THEN 72 WHEN list_contains(annotations, 'Transactional') THEN 48 ELSE 0 END"
_VALID = "CASE WHEN regexp_matches(lower(name), '(validat|constraint)') THEN 72 WHEN list_contains(annotations, 'Valid') THEN 48 ELSE 0 END"
_ENTRY = "CASE WHEN kind = 'method' AND lower(name) = 'main' THEN 125 ELSE 0 END + CASE WHEN kind IN ('class','interface') AND ends_with(lower(name), 'application') THEN 42 ELSE 0 END"
_SHOWN = "id, fq_name, name, kind, role, n_matched, score"


def _ranked(text):
    def run(spark, sf_dir):
        return K.ranked_symbols(search_symbols(spark, sf_dir), K.asked(text)).select("id", "fq_name", "name", "kind", "role", "n_matched", "score")

    return run


@query(sql("found_symbols", rest=_symbol_sql("RedBolt handler", ["red", "bolt", "handler"]) + f" SELECT {_SHOWN} FROM s"))
def ft06_scored_tokens(spark, sf_dir):
    return _ranked("RedBolt handler")(spark, sf_dir)


@query(sql("found_symbols", rest=_symbol_sql("RedBoltService.handleBolt", ["red", "bolt", "handle"]) + f" SELECT {_SHOWN} FROM s"))
def ft06_qualified_member(spark, sf_dir):
    return _ranked("RedBoltService.handleBolt")(spark, sf_dir)


@query(sql("found_symbols", rest=_symbol_sql("where is the red_bolt table", ["where", "is", "red", "bolt", "table"]) + f" SELECT {_SHOWN} FROM s"))
def ft06_database_name(spark, sf_dir):
    return _ranked("where is the red_bolt table")(spark, sf_dir)


@query(sql("found_symbols", rest=_symbol_sql("main application entry point", ["main", "application", "entry", "point"], entry=_ENTRY, lone="n_matched = 1 AND (contains(t, 'point') OR contains(c, 'point'))") + f" SELECT {_SHOWN} FROM s"))
def ft11_entry_point(spark, sf_dir):
    return _ranked("main application entry point")(spark, sf_dir)


@query(sql("found_symbols", rest=_symbol_sql("cached login permission", ["cached", "login", "permission"], concepts=f"least({_AUTH} + {_CACHE}, 100)") + f" SELECT {_SHOWN} FROM s"))
def ft09_concepts(spark, sf_dir):
    return _ranked("cached login permission")(spark, sf_dir)


@query(sql("found_symbols", rest="SELECT id, fq_name FROM found_symbols WHERE contains(lower(name), 'validat') OR contains(lower(name), 'constraint') OR contains(lower(name), 'transaction') OR contains(lower(name), 'rollback') OR contains(lower(name), 'unitofwork') OR list_has_any(annotations, ['Transactional', 'Valid'])"))
def ft10_concept_candidates(spark, sf_dir):
    return K.concept_candidates(search_symbols(spark, sf_dir), K.asked("validate the transaction")).select("id", "fq_name")


@query(sql("found_symbols", rest=_symbol_sql("small widget", ["small", "widget"]) + f" SELECT id, fq_name, score FROM s ORDER BY score DESC, {FILE_RANK} DESC, name, fq_name, file, id LIMIT 20 OFFSET 10"))
def ft05_search_symbols(spark, sf_dir):
    rows = K.ranked_symbols(search_symbols(spark, sf_dir), K.asked("small widget"))
    return R.page(rows, [*K.symbol_order(), F.col("id")], 10, 20).select("id", "fq_name", "score")


@query(sql("found_symbols", rest="SELECT id, name, role FROM found_symbols ORDER BY CASE role WHEN 'main_source' THEN 0 WHEN 'resource_config' THEN 1 WHEN 'build_config' THEN 2 WHEN 'test_source' THEN 3 WHEN 'mock_source' THEN 4 WHEN 'generated' THEN 5 ELSE 6 END, name, id LIMIT 50"))
def ft05_list_mode(spark, sf_dir):
    rows = search_symbols(spark, sf_dir).select("id", "name", "role").withColumn("fq_name", F.format_string("%012d", "id"))
    return K.listed(rows, "name", 0, 50).select("id", "name", "role")


@query(sql("found_symbols", rest=_symbol_sql("small widget", ["small", "widget"]) + """ SELECT 'role' AS dim, role AS value, count(*) AS n FROM s GROUP BY role UNION ALL SELECT 'kind', kind, count(*) FROM s GROUP BY kind UNION ALL SELECT 'framework_role', coalesce(framework_role, 'none'), count(*) FROM s GROUP BY ALL
 UNION ALL SELECT 'synthetic', synthetic::VARCHAR, count(*) FROM s GROUP BY synthetic UNION ALL SELECT 'total', 'all', count(*) FROM s UNION ALL SELECT 'confidence', 'all', CASE WHEN max(score) >= 90 THEN 85 ELSE 65 END FROM s"""))
def ft05_search_summary(spark, sf_dir):
    return K.search_summary(search_symbols(spark, sf_dir), "small widget")


def _file_sql(text: str, tokens: list[str], phrase: str, base: str, parts: list[str], broad: list[str] = (), wants: str = "0", concepts: list[str] = ()) -> str:
    """Scores of files by the definition; ``base`` and ``parts`` are the tests of a basename's words."""
    low, n = text.lower(), len(tokens)
    said = "concat_ws(' ', lower(name), lower(fq_name), lower(kind), lower(signature), lower(coalesce(framework_role, '')), lower(array_to_string(annotations, ' ')))"
    sym = ", ".join(f"max(contains({said}, '{t}')::INT) AS s{k}" for k, t in enumerate(tokens))
    end = ", ".join(f"max(contains(lower(method || ' ' || path), '{t}')::INT) AS e{k}" for k, t in enumerate(tokens))
    con = "".join(f", max((({c}) > 0)::INT) AS c{k}" for k, c in enumerate(concepts))
    in_path = " + ".join(f"contains(lower(path), '{t}')::INT" for t in tokens)
    special = " + ".join(f"({p})::INT" for p, t in zip(parts, tokens) if t not in broad) or "0"
    every = " + ".join(f"({p})::INT" for p in parts)
    words = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_extract(path, '([^/]+)[.][^./]+$', 1), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
    hits = " + ".join(f"(contains(lower(path), '{t}') OR contains({_small('path')}, '{t}') OR contains('java ' || role, '{t}') OR coalesce(s{k}, 0) = 1 OR coalesce(e{k}, 0) = 1)::INT" for k, t in enumerate(tokens))
    marks = " + ".join(f"coalesce(c{k}, 0)" for k in range(len(concepts))) or "0"
    return f"""WITH sy AS (SELECT file AS path, max(({phrase})::INT) AS ph, bool_or(contains(coalesce(framework_role,''), 'service') OR ends_with(name, 'Service')) AS is_service, bool_or(contains(coalesce(framework_role,''), 'repository') OR ends_with(name, 'Repository')) AS is_repository, {sym}{con} FROM found_symbols GROUP BY 1),
 en AS (SELECT file AS path, 1 AS has, {end}, max(contains(lower(method || ' ' || path), '{low}')::INT) AS ep FROM found_endpoints GROUP BY 1),
 j AS (SELECT *, {words} AS ws, lower(regexp_extract(path, '([^/]+)[.][^./]+$', 1)) AS bn FROM found_files LEFT JOIN sy USING (path) LEFT JOIN en USING (path)),
 s AS (SELECT path, role, (CASE WHEN lower(path) = '{low}' OR bn || '.java' = '{low}' THEN 120 WHEN contains(lower(path), '{low}') THEN 90 ELSE 0 END + CASE WHEN ({in_path}) = {n} THEN 70 ELSE 18 * ({in_path}) END + CASE WHEN {base} THEN 90 ELSE 0 END
  + 45 * ({special}) + CASE WHEN ({every}) >= 2 AND ({special}) >= 1 THEN 110 ELSE 0 END + 80 * coalesce(ph, 0) + 20 * ({' + '.join(f'coalesce(s{k}, 0)' for k in range(n))}) + CASE WHEN coalesce(ep, 0) = 1 THEN 55 ELSE 24 * ({' + '.join(f'coalesce(e{k}, 0)' for k in range(n))}) END
  + {wants} + least(coalesce(degree, 0), 10) + floor({FILE_RANK} / 10 + 0.5) + least(55 * ({marks}), 100))::BIGINT AS score, ({hits})::INT AS n_matched, ({marks}) > 0 AS con FROM j)
 SELECT path, role, score, n_matched FROM s WHERE n_matched > 0 OR con OR score > {FILE_RANK} / 10"""


def _word(x: str, *others: str) -> str:
    return "list_has_any(ws, [" + ", ".join(f"'{w}'" for w in (x, *others)) + "])"


_COVER = "(SELECT count(DISTINCT t) FROM (SELECT unnest(['red', 'bolt']) AS t) WHERE list_contains(list_filter(regexp_split_to_array(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''), t)) = 2"


@query(sql("found_symbols", "deps", "endpoints", "found_files", "found_endpoints", rest=_file_sql("red bolt service", ["red", "bolt"], _COVER, "bn IN ('red', 'bolt')", [_word("red"), _word("bolt")], wants="CASE WHEN is_service THEN 32 ELSE 0 END")))
def ft08_scored_files(spark, sf_dir):
    q = K.asked("red bolt service", T.FILE_STOP_WORDS)
    return K.ranked_files(search_files(spark, sf_dir), search_symbols(spark, sf_dir), file_endpoints(spark, sf_dir), q).select("path", "role", "score", "n_matched")


@query(sql("found_symbols", "deps", "endpoints", "found_files", "found_endpoints", rest="SELECT path, score FROM (" + _file_sql("caching of widgets", ["caching", "widgets"], "contains(name, 'Widget') AND contains(name, 'Cache')", "false", [_word("cache", "caching"), _word("widget", "widgets")], concepts=[_CACHE]) + f") ORDER BY score DESC, {FILE_RANK} DESC, path LIMIT 20"))
def ft07_search_files(spark, sf_dir):
    return K.search_files(search_files(spark, sf_dir), search_symbols(spark, sf_dir), file_endpoints(spark, sf_dir), "caching of widgets").select("path", "score")


@query(sql("found_symbols", rest="WITH p AS (" + _symbol_sql("small widget", ["small", "widget"]) + """ SELECT fq_name || '#' || id AS key, score::DOUBLE AS score FROM s), e AS (SELECT fq_name || '#' || id AS key, coalesce(in_degree, 0)::DOUBLE AS score FROM found_symbols)
 SELECT section, place, key, score FROM (SELECT 'symbols' AS section, row_number() OVER (ORDER BY score DESC, key) AS place, key, score FROM p UNION ALL SELECT 'central', row_number() OVER (ORDER BY score DESC, key), key, score FROM e) WHERE place <= 10"""))
def ft13_mixed_sections(spark, sf_dir):
    s = search_symbols(spark, sf_dir)
    key = F.concat("fq_name", F.lit("#"), "id").alias("key")
    found = K.ranked_symbols(s, K.asked("small widget")).select(key, "score")
    central = s.select(key, F.coalesce("in_degree", F.lit(0)).alias("score"))
    top = lambda df: df.orderBy(F.desc("score"), "key").limit(10)
    return K.mixed({"symbols": top(found), "central": top(central)})


_RES = "CASE l.l_linenumber % 4 WHEN 0 THEN 'receiver-field' WHEN 1 THEN 'name-only' WHEN 2 THEN 'super-method' ELSE 'name-unique' END"


@query(f"""WITH c AS (SELECT CASE p.p_partkey % 6 WHEN 0 THEN 'Order' || 'Service.' WHEN 1 THEN 'Logger.' WHEN 2 THEN 'Plain.' WHEN 3 THEN 'UserRequest.' WHEN 4 THEN 'Service.' ELSE 'Request.' END || CASE WHEN l.l_linenumber % 2 = 0 THEN 'new' ELSE 'run' END AS callee, round(1 - l_discount * 5, 4) AS confidence,
 CASE l_returnflag WHEN 'R' THEN 'low_signal' WHEN 'A' THEN 'primary' ELSE 'provider' END AS tier, {_RES} AS resolution FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)
 SELECT callee, tier, resolution, round(max(confidence * 100 + CASE tier WHEN 'provider' THEN 30 WHEN 'primary' THEN 20 ELSE 5 END + CASE WHEN resolution IN ('receiver-field','super-method') THEN 8 ELSE 0 END + CASE WHEN split_part(callee, '.', 1) IN ('Service','Request') THEN 18 ELSE 0 END
 - CASE WHEN starts_with(callee, 'Logger.') THEN 24 ELSE 0 END - CASE WHEN ends_with(callee, '.new') AND split_part(callee, '.', 1) NOT IN ('Service','Request') THEN 8 ELSE 0 END), 4) AS score FROM c GROUP BY ALL""")
def ft18_call_edge_score(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey")
    c = li.selectExpr("concat(CASE l_partkey % 6 WHEN 0 THEN 'OrderService.' WHEN 1 THEN 'Logger.' WHEN 2 THEN 'Plain.' WHEN 3 THEN 'UserRequest.' WHEN 4 THEN 'Service.' ELSE 'Request.' END, CASE WHEN l_linenumber % 2 = 0 THEN 'new' ELSE 'run' END) AS callee", "round(1 - l_discount * 5, 4) AS confidence",
                      "CASE l_returnflag WHEN 'R' THEN 'low_signal' WHEN 'A' THEN 'primary' ELSE 'provider' END AS tier", _RES.replace("l.", "") + " AS resolution")
    return c.groupBy("callee", "tier", "resolution").agg(F.round(F.max(K.call_edge_score()), 4).alias("score"))


@query(sql("found_symbols", rest="""WITH e AS (SELECT DISTINCT CASE WHEN id % 3 = 0 THEN name || '.new' ELSE fq_name || '(int)' END AS callee, CASE WHEN id % 2 = 0 THEN file ELSE package || '/Other.ts' END AS edge_file, lower(name) AS w FROM found_symbols WHERE id % 7 < 3),
 j AS (SELECT e.callee, e.edge_file, s.fq_name, s.file, s.line, CASE WHEN ends_with(e.edge_file, '.java') THEN 80 ELSE 0 END + 8 * CASE WHEN s.file = e.edge_file THEN 2 WHEN split_part(s.file,'/',1) = split_part(e.edge_file,'/',1) THEN 1 ELSE 0 END
 + CASE role WHEN 'main_source' THEN 20 WHEN 'test_source' THEN -20 ELSE 0 END + CASE WHEN kind = 'method' THEN 20 ELSE 0 END + CASE WHEN contains(lower(fq_name), lower(replace(callee, '(int)', ''))) THEN 35 ELSE 0 END
 + CASE WHEN lower(replace(callee, '(int)', '')) = w OR ends_with(lower(replace(callee, '(int)', '')), '.' || w) THEN 15 ELSE 0 END + CASE WHEN ends_with(callee, '.new') THEN CASE WHEN kind IN ('class','interface','enum') THEN 50 ELSE 30 END ELSE 0 END + CASE WHEN s.file = e.edge_file THEN 5 ELSE 0 END AS score
 FROM e JOIN found_symbols s ON lower(s.name) = e.w) SELECT callee, edge_file, fq_name, file, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY callee, edge_file ORDER BY score DESC, line, fq_name, file) AS rn FROM j) WHERE rn = 1"""))
def ft19_best_definition(spark, sf_dir):
    s = search_symbols(spark, sf_dir)
    e = s.filter("id % 7 < 3").selectExpr("CASE WHEN id % 3 = 0 THEN concat(name, '.new') ELSE concat(fq_name, '(int)') END AS callee", "CASE WHEN id % 2 = 0 THEN file ELSE concat(package, '/Other.ts') END AS file")
    return K.best_definitions(e, s)


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat_ws(',', a, b) WHEN 1 THEN concat_ws(',', a, b, 'ofthe', 'query', 'xquery') ELSE concat_ws(',', a, b, 'bc', 'abc') END AS words
 FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def fn_tokens(spark, sf_dir):
    x = F.expr("concat(p_name, CASE p_partkey % 3 WHEN 0 THEN 'Service' WHEN 1 THEN ' ofThe xQuery' ELSE '.aBc' END)")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.tokens(x), ",").alias("words"))
