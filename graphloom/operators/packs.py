"""Answers made of several operators: one table of sections (section, place, key, value) each, ready to be cut to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranking as K
from .relational import right_size, top_per_key


def section(df: DataFrame, name: str, key: str, value: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of a table as a section."""
    rows = df.orderBy(*order).limit(most).withColumn("_one", F.lit(1))  # a page
    return rows.withColumn("place", F.row_number().over(W.partitionBy("_one").orderBy(*order))).select(F.lit(name).alias("section"), "place", F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))


def together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def within(sections: DataFrame, budget: int) -> DataFrame:
    """Sections cut to ``budget`` characters: rows come by their place across all sections until the budget is spent."""
    size = F.length("key") + F.coalesce(F.length("value"), F.lit(0))
    w = W.orderBy("place", "section").rowsBetween(W.unboundedPreceding, 0)  # a page
    return sections.withColumn("_u", F.sum(size).over(w)).filter(F.col("_u") <= budget).drop("_u")


def slices(texts: DataFrame, wanted: DataFrame, most: int | None = 20) -> DataFrame:
    """file, first, last, text: lines ``first`` to ``last`` (1-based, both in) of each wanted slice, the first ``most`` of them (None: all)."""
    few = wanted if most is None else wanted.orderBy("file", "first", "last").limit(most)
    rows = texts.join(few, "file")
    lines = F.split("text", "\r?\n")
    part = F.slice(lines, F.greatest("first", F.lit(1)), F.greatest(F.least(F.col("last"), F.size(lines)) - F.greatest("first", F.lit(1)) + 1, F.lit(0)))
    return rows.select("file", "first", "last", F.array_join(part, "\n").alias("text"))


def file_summary(path: str, symbols: DataFrame, imports: DataFrame, dependencies: DataFrame, endpoints: DataFrame, most: int = 40) -> DataFrame:
    """Classes, members, imports, dependencies, dependents and endpoints of one file; ``cut`` counts what each section leaves out."""
    own = symbols.filter(F.col("file") == path)
    types = ("class", "interface", "enum", "type")
    by_line = [F.col("line"), F.col("fq_name")]
    parts = {
        "classes": (own.filter(F.col("kind").isin(*types)), "fq_name", "kind", by_line), "members": (own.filter(~F.col("kind").isin(*types)), "fq_name", "kind", by_line),
        "imports": (imports.filter(F.col("path") == path).select("source", "path").distinct(), "source", "path", [F.col("source")]),
        "dependencies": (dependencies.filter(F.col("a") == path), "b", "a", [F.col("b")]), "dependents": (dependencies.filter(F.col("b") == path), "a", "b", [F.col("a")]),
        "endpoints": (endpoints.filter(F.col("file") == path), "path", "method", [F.col("path"), F.col("method")]),
    }
    shown = together([section(df, name, key, value, order, most) for name, (df, key, value, order) in parts.items()])
    left = together([df.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("n")).select(F.lit("cut").alias("section"), F.lit(k + 1).alias("place"), F.lit(name).alias("key"), F.col("n").cast("string").alias("value")) for k, (name, (df, *_)) in enumerate(parts.items())])
    return shown.union(left)


def patch_impact(patches: DataFrame, symbols: DataFrame, dependencies: DataFrame, calls: DataFrame, endpoints: DataFrame, tests: DataFrame) -> DataFrame:
    """patch, n_files, n_symbols, n_dependents, n_callers, n_endpoints, n_impacted, n_tests, score, level, flags of patches (patch, path).

    dependents: files that import a changed one; callers: distinct callers outside the patch of a symbol in it; impacted: endpoints
    in dependents; tests: test files among dependents.  Changed endpoints, or ten dependents or callers, make a patch high.
    """
    n = F.count(F.lit(1))
    changed = patches.select("patch", "path").distinct()
    per = changed.groupBy("patch").agg(n.alias("n_files"))
    near = dependencies.join(changed.withColumnRenamed("path", "b"), "b").select("patch", F.col("a").alias("path")).distinct().join(changed, ["patch", "path"], "left_anti")
    named = changed.join(symbols.select(F.col("file").alias("path"), "callee"), "path")
    callers = named.join(calls.select("callee", "caller", F.col("file").alias("from")), "callee").join(changed.select("patch", F.col("path").alias("from"), F.lit(1).alias("own")), ["patch", "from"], "left").filter("own IS NULL")
    served = endpoints.select(F.col("file").alias("path"), F.col("id").alias("endpoint"))
    sides = (
        named.groupBy("patch").agg(n.alias("n_symbols")), near.groupBy("patch").agg(n.alias("n_dependents")), callers.groupBy("patch").agg(F.countDistinct("caller").alias("n_callers")),
        changed.join(served, "path").groupBy("patch").agg(F.countDistinct("endpoint").alias("n_endpoints")), near.join(served, "path").groupBy("patch").agg(F.countDistinct("endpoint").alias("n_impacted")),
        near.join(tests.select("path"), "path", "left_semi").groupBy("patch").agg(n.alias("n_tests")),
    )
    for s in sides:
        per = per.join(s, "patch", "left")
    per = per.fillna(0).withColumn("score", F.expr("n_files + 2 * n_dependents + n_callers + 5 * n_endpoints + 3 * n_impacted + least(n_tests, 5)"))
    wide = (F.col("n_dependents") >= 10) | (F.col("n_callers") >= 10)
    flags = F.array_compact(F.array(F.when(F.col("n_endpoints") > 0, "endpoint-change"), F.when(F.col("n_impacted") > 0, "dependent-endpoint"), F.when(wide, "high-fanout"), F.when(F.col("n_tests") == 0, "no-tests-found")))
    level = F.when((F.col("n_endpoints") > 0) | wide | (F.col("score") >= 18), "high").when(F.col("score") >= 5, "medium").otherwise("low")
    return per.withColumn("level", level).withColumn("flags", F.array_join(flags, ","))


def endpoint_packet(endpoints: DataFrame, symbols: DataFrame, calls: DataFrame, tests: DataFrame, most: int = 25) -> DataFrame:
    """Each endpoint's (id, method, path, file) handler file, related services and repositories, first calls and tests, as counts and
    the first names: id, handler, services, repositories, calls, n_calls, n_tests."""
    role = F.lower(F.coalesce("framework_role", F.lit("")))
    like = {"services": role.contains("service") | F.col("name").endswith("Service"), "repositories": role.contains("repository") | F.col("name").endswith("Repository") | F.col("name").endswith("Dao")}
    near = symbols.groupBy("file").agg(*(F.array_join(F.slice(F.sort_array(F.collect_set(F.when(c, F.col("name")))), 1, 5), " ").alias(k) for k, c in like.items()))
    made = top_per_key(calls, ["file"], [F.desc("confidence"), F.col("line"), F.col("callee"), F.col("caller")], most).groupBy("file").agg(F.array_join(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("rn", "callee"))), lambda x: x["callee"]), 1, 3), " ").alias("calls"), F.count(F.lit(1)).alias("n_calls"))
    tested = tests.groupBy("file").agg(F.countDistinct("test").alias("n_tests"))
    out = endpoints.join(near, "file", "left").join(made, "file", "left").join(tested, "file", "left").fillna(0, ["n_calls", "n_tests"])
    return out.select("id", F.col("file").alias("handler"), "services", "repositories", "calls", "n_calls", "n_tests")


def research_pack(text: str, files: DataFrame, symbols: DataFrame, endpoints: DataFrame, edges: DataFrame, calls: DataFrame, keep: float = 0.5, most: int = 12) -> DataFrame:
    """Files (right-sized by score, three at least), symbols, files one edge away, and the most telling calls of those symbols.

    What several sections read is written once, as are the few files and symbols found: their scores are long expressions over derived
    columns, which each further use in the same plan would repeat.
    """
    from ..functions.text import FILE_STOP_WORDS
    from .graph import neighbours, written

    symbols, files, endpoints = written(symbols, "symbols"), written(files, "files"), written(endpoints, "endpoints")
    f = K.search_files(files, symbols, endpoints, text, most).select("path", "score").withColumn("g", F.lit(1))
    f = written(right_size(f, ["g"], "score", keep, 3, "path").drop("g", "rn"), "found-files")
    s = written(K.ranked_symbols(symbols, K.asked(text, FILE_STOP_WORDS)).orderBy(*K.symbol_order()).limit(most), "found-symbols")
    near = neighbours(edges, f.select(F.col("path").alias("file")), files.select(F.col("path").alias("file"), "role", "language"))
    told = calls.join(s.select(F.col("callee_name").alias("callee")), "callee", "left_semi").withColumn("score", K.call_edge_score())
    return together([
        section(f, "files", "path", "score", [F.desc("score"), F.col("path")], most), section(s, "symbols", "fq_name", "score", [F.desc("score"), F.col("name"), F.col("fq_name"), F.col("file")], most),
        section(near, "neighbours", "file", "hits", [F.desc("hits"), F.col("file")], most), section(told, "calls", "callee", "caller", [F.desc("score"), F.col("callee"), F.col("caller"), F.col("file"), F.col("line")], most),
    ])


def status(counts: DataFrame) -> DataFrame:
    """``counts`` (files, symbols, errors, stale) with state: missing, unindexed, degraded, stale or ready, and a score of 100 at most."""
    state = F.when(F.col("files").isNull(), "missing").when(F.col("symbols") == 0, "unindexed").when(F.col("errors") * 10 > F.col("files"), "degraded").when(F.col("stale"), "stale").otherwise("ready")
    score = F.when(F.col("files").isNull(), 20).when(F.col("symbols") == 0, 50).otherwise(100 - F.when(F.col("stale"), 15).otherwise(0) - F.when(F.col("errors") * 10 > F.col("files"), 20).otherwise(0))
    return counts.withColumn("state", state).withColumn("score", score)


def field_seeds(text: str, named: tuple[str, ...] = (), most: int = 80) -> list[str]:
    """Names of fields that a request may mean: those given outright, then words of its text of four letters or more that are no
    keywords, constants or words of a question; a dotted name comes whole and by its last part."""
    import re

    from ..functions.text import RESEARCH_STOP_WORDS

    out: list[str] = []
    for value, given in [*((n, True) for n in named), (text, False)]:
        for token in re.findall(r"\b[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)?\b", value):
            last = token.rsplit(".", 1)[-1]
            if len(last) < 2 or last in KEYWORDS or (not given and "." not in token and (len(last) < 4 or last.lower() in RESEARCH_STOP_WORDS)) or (re.fullmatch("[A-Z0-9_]+", last) and "." not in token):
                continue
            out += [token, last] if "." in token else [token]
    return list(dict.fromkeys(out))[:most]


#: Words of the languages themselves.
KEYWORDS = (
    "class", "interface", "enum", "public", "private", "protected", "static", "final", "return", "new", "void", "int", "long", "double", "float", "boolean", "char", "byte", "short", "if", "else", "for", "while", "switch", "case",
    "try", "catch", "true", "false", "null", "this", "super", "package", "import",
)


def field_impact(seeds: list[str], fields: DataFrame, usages: DataFrame, calls: DataFrame, endpoints: DataFrame, is_test: Column) -> DataFrame:
    """field, n_definitions, n_reads, n_writes, n_methods, n_callers, n_endpoints, n_test_files of the fields (name, owner) that a seed is part of.

    ``usages``: field, access, method, file, confidence (0.5 or more count); ``calls``: callee (a method), caller; ``endpoints``:
    file; ``is_test`` tells a using file's role.
    """
    hit = F.lit(False)
    for s in seeds:
        hit = hit | F.contains(F.lower("name"), F.lit(s.rsplit(".", 1)[-1].lower()))
    defined = fields.filter(hit).groupBy(F.col("name").alias("field")).agg(F.count(F.lit(1)).alias("n_definitions"))
    used = usages.filter("confidence >= 0.5").join(defined.select("field"), "field", "left_semi")
    per = used.groupBy("field").agg(F.count_if(F.col("access").isin("read", "read_write")).alias("n_reads"), F.count_if(F.col("access").isin("write", "read_write", "init")).alias("n_writes"), F.countDistinct("method").alias("n_methods"), F.countDistinct(F.when(is_test, F.col("file"))).alias("n_test_files"))
    callers = used.select("field", F.col("method").alias("callee")).distinct().join(calls.select("callee", "caller").distinct(), "callee").groupBy("field").agg(F.countDistinct("caller").alias("n_callers"))
    served = used.select("field", "file").distinct().join(endpoints.groupBy("file").agg(F.count(F.lit(1)).alias("n")), "file").groupBy("field").agg(F.sum("n").alias("n_endpoints"))
    out = defined.join(per, "field", "left").join(callers, "field", "left").join(served, "field", "left").fillna(0)
    return out.select("field", "n_definitions", "n_reads", "n_writes", "n_methods", "n_callers", "n_endpoints", "n_test_files")


def review_batches(files: DataFrame, budget: int, most: int) -> DataFrame:
    """path, batch: changed files (path, size, risk) in batches of at most ``most`` files and about ``budget`` characters, riskiest first.

    A file's batch follows from the characters and files before it, so batches are made in one pass over a review's files.
    """
    w = W.orderBy(F.desc("risk"), "path")  # files of one review
    before = F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = files.withColumn("by_size", F.floor(before / budget)).withColumn("by_count", F.floor((F.row_number().over(w) - 1) / most))
    return rows.select("path", F.greatest("by_size", "by_count").alias("batch"))


def review_result(findings: DataFrame, expected: DataFrame, reviewed: DataFrame) -> DataFrame:
    """One row: unique findings by priority, coverage, and the exit code: 1 with a P0, 2 where a batch was not reviewed, else 0."""
    unique = findings.groupBy("id").agg(F.min("priority").alias("priority"))
    n = unique.agg(*(F.count_if(F.col("priority") == p).alias(p.lower()) for p in ("P0", "P1", "P2")))
    both = expected.select("batch").distinct().join(reviewed.select("batch", F.lit(1).alias("r")).distinct(), "batch", "left").agg(F.count(F.lit(1)).alias("batches"), F.count("r").alias("done"))
    one = F.lit(1).alias("_one")
    out = n.select("*", one).join(both.select("*", one), "_one").drop("_one")
    return out.withColumn("exit_code", F.when(F.col("p0") > 0, 1).when(F.col("done") < F.col("batches"), 2).otherwise(0))


def atlas(files: DataFrame, modules: DataFrame, module_edges: DataFrame, hotspots: DataFrame, endpoints: DataFrame, symbols: DataFrame, most: int = 10) -> DataFrame:
    """Languages by bytes, modules by files, module dependencies by edges, hotspots by weight, entry points (endpoints, then main
    methods and application classes): the first ``most`` of each."""
    languages = files.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    mains = symbols.filter("kind = 'method' AND name = 'main' OR kind = 'class' AND name LIKE '%Application'").select(F.col("fq_name").alias("key"), F.col("kind").alias("value"), F.lit(1).alias("p"))
    entries = endpoints.select(F.concat_ws(" ", "method", "path").alias("key"), F.col("file").alias("value"), F.lit(0).alias("p")).union(mains).distinct()
    edges = module_edges.select(F.concat_ws(" > ", "source", "target").alias("key"), "edge_count")
    return together([
        section(languages, "languages", "language", "bytes", [F.desc("bytes"), F.col("language")], most), section(modules.groupBy("module").agg(F.count(F.lit(1)).alias("n")), "modules", "module", "n", [F.desc("n"), F.col("module")], most),
        section(edges, "module dependencies", "key", "edge_count", [F.desc("edge_count"), F.col("key")], most), section(hotspots, "hotspots", "path", "weight", [F.desc("weight"), F.col("path")], most),
        section(entries, "entry points", "key", "value", [F.col("p"), F.col("key"), F.col("value")], most),
    ])
