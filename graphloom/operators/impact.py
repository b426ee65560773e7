"""Impact, overlay and selection operators: rules as column expressions, graphs as unions of projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE = "*"  # what a count counts


def symbol_impact(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """fq_name with its calls, callers, calling files and provider calls; ``symbols`` has fq_name and callee."""
    per = calls.groupBy("callee", "caller", "file").agg(F.count(ONE).alias("n"), F.count_if(F.col("tier") == "provider").alias("p"))
    out = symbols.join(per, "callee", "left").groupBy("fq_name")
    return out.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_calls"), F.countDistinct("caller").alias("n_callers"), F.countDistinct("file").alias("n_files"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_provider"))


def ci_decision(path: str, role: str, language: str, status: str, ignorable: str) -> Column:
    """What a changed path does to test selection; deleted, configuration and unknown paths run everything."""
    return (
        F.when(F.col(status) == "D", "deleted").when(F.col(role).isin("build_config", "resource_config"), "configuration").when(F.col(language).isNull(), "unknown")
        .when(F.col(role) == "test_source", "changed_test").when(F.col(path).rlike(ignorable), "ignorable").otherwise("select")
    )


def tier_confidence(tier: str, confidence: str) -> Column:
    """Low-signal edges have at most 0.25, provider edges at least 0.9."""
    c = F.col(confidence)
    return F.when(F.col(tier) == "low_signal", F.least(c, F.lit(0.25))).when(F.col(tier) == "provider", F.greatest(c, F.lit(0.9))).otherwise(c)


def overlay(defined: DataFrame, calls: DataFrame, handled: DataFrame) -> DataFrame:
    """type, source, target, edge_count from (file, fq_name), (file, callee) and (endpoint, file)."""
    edges = defined.select(F.lit("defines").alias("type"), F.col("file").alias("source"), F.col("fq_name").alias("target"))
    edges = edges.union(defined.select(F.lit("contains"), F.substring_index("file", "/", 1), "file"))
    edges = edges.union(calls.select(F.lit("calls"), "file", "callee")).union(handled.select(F.lit("handles"), "endpoint", "file"))
    return edges.groupBy("type", "source", "target").agg(F.count(ONE).alias("edge_count"))


def blast_radius(m: DataFrame) -> DataFrame:
    """Score and band of module, files, dependents, callers, endpoints, tests."""
    m = m.withColumn("tests", F.least("tests", F.lit(5))).withColumn("score", F.expr("files + 2 * dependents + callers + 5 * endpoints + tests"))
    band = F.when((F.col("endpoints") > 0) | (F.col("callers") >= 10) | (F.col("score") >= 18), "high").when(F.col("score") >= 5, "medium").otherwise("low")
    return m.select("module", "files", "dependents", "callers", "endpoints", "tests", "score", band.alias("radius"))


def joined_path(base: Column, path: Column) -> Column:
    """One absolute path of a base and a handler's own path, without doubled or trailing slashes."""
    joined = F.regexp_replace(F.concat(base, F.lit("/"), path, F.lit("/")), "/+", "/")
    return F.concat(F.lit("/"), F.regexp_replace(joined, "^/|/$", ""))


#: What a relative import may name after the path as it is written, in order of priority.
CANDIDATES = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")


def _folded(path: Column) -> Column:
    """A path without ``.`` and ``..``: parts are taken from the left, ``..`` drops the part before it; null above the root."""
    start = F.array().cast("array<string>")
    step = lambda out, p: F.when(p == "..", F.when(F.size(out) > 0, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(F.array(F.lit("..")))).when((p == ".") | (p == ""), out).otherwise(F.concat(out, F.array(p)))
    parts = F.aggregate(F.split(path, "/"), start, step)
    return F.when(~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def import_graph(imports: DataFrame, files: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """importer, target of relative imports (path, specifier) that name one of ``files`` (path), and of ``dependencies`` (a, b).

    The path as it is written comes first, then without its script extension (``./a.js`` may be ``a.ts``) with each other one;
    the first that is a file wins.
    """
    bare = F.regexp_replace("specifier", r"\.(js|jsx|mjs|cjs|ts|tsx)$", "")
    folder = F.regexp_replace("path", "[^/]*$", "")
    whole, base = _folded(F.concat(folder, "specifier")), _folded(F.concat(folder, bare))
    rows = imports.filter(F.col("specifier").startswith(".")).select(F.col("path").alias("importer"), "specifier", F.posexplode(F.array(whole, *(F.concat(base, F.lit(c)) for c in CANDIDATES))).alias("k", "target"))
    found = rows.join(files.select(F.col("path").alias("target")).distinct(), "target")
    found = found.groupBy("importer", "specifier").agg(F.min_by("target", "k").alias("target")).select("importer", "target")
    if dependencies is not None:
        found = found.union(dependencies.select("a", "b"))
    return found.filter("importer <> target").distinct()


def calculation_sinks(lines: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """output, n, n_files, risk: numeric assignments by the name they set, riskier with rounding or division."""
    name = F.regexp_extract(line, r"(\w*(?:total|amount|price|sum|rate|tax|count|balance)\w*)\s*[-+*/]?=[^=]", 1)
    risk = F.when(F.col(line).rlike(r"/|\bround|setScale|toFixed"), 2).when(F.col(line).rlike(r"[-+*]"), 1).otherwise(0)
    rows = lines.select(file, F.lower(name).alias("output"), risk.alias("risk")).filter("output <> ''")
    return rows.groupBy("output").agg(F.count(ONE).alias("n"), F.countDistinct(file).alias("n_files"), F.max("risk").alias("risk"))


def symbol_packet(symbols: DataFrame, calls: DataFrame, endpoints: DataFrame, is_test: Column) -> DataFrame:
    """id, fq_name, n_callers, n_callees, n_endpoints, n_tests: what hangs on a symbol (as_callee, as_caller, file), by counts
    of each side made once; ``is_test`` tells a calling file's role."""
    incoming = calls.groupBy(F.col("callee").alias("as_callee")).agg(F.count(ONE).alias("n_callers"), F.countDistinct(F.when(is_test, F.col("file"))).alias("n_tests"))
    outgoing = calls.groupBy(F.col("caller").alias("as_caller")).agg(F.count(ONE).alias("n_callees"))
    served = endpoints.groupBy("file").agg(F.count(ONE).alias("n_endpoints"))
    out = symbols.join(incoming, "as_callee", "left").join(outgoing, "as_caller", "left").join(served, "file", "left")
    return out.fillna(0, ["n_callers", "n_callees", "n_endpoints", "n_tests"]).select("id", "fq_name", "n_callers", "n_callees", "n_endpoints", "n_tests")


def impact_radius(targets: DataFrame, edges: DataFrame, calls: DataFrame, endpoints: DataFrame, most_calls: int = 100) -> DataFrame:
    """target, dependents, callers, endpoints, score, radius: how far targets (target, file) reach.

    Dependents are files that import the target's (``edges``: a imports b), callers the calls (callee) whose name ends with the target's
    segments, at most ``most_calls`` of them, endpoints (file) those in dependents; high from 10 on, medium from 3.
    """
    own = targets.select("target", "file").distinct()
    near = own.join(edges.select("a", F.col("b").alias("file")).distinct(), "file").select("target", "a")
    n = near.groupBy("target").agg(F.countDistinct("a").alias("dependents"))
    served = near.join(endpoints.groupBy(F.col("file").alias("a")).agg(F.count(ONE).alias("n")), "a").groupBy("target").agg(F.sum("n").alias("endpoints"))
    # a callee's suffixes meet targets by equality; calls are counted by callee first
    parts = F.split(F.regexp_replace("callee", r"\(.*\)$", ""), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    by_name = calls.groupBy("callee").agg(F.count(ONE).alias("n")).select(F.explode(F.array_distinct(suffixes)).alias("target"), "n")
    met = by_name.groupBy("target").agg(F.least(F.sum("n"), F.lit(most_calls)).alias("callers"))
    out = own.select("target").distinct()
    for part in (n, met, served):
        out = out.join(part, "target", "left")
    out = out.fillna(0).withColumn("score", F.col("dependents") + F.col("callers") + F.col("endpoints"))
    return out.withColumn("radius", F.when(F.col("score") >= 10, "high").when(F.col("score") >= 3, "medium").otherwise("low"))


def cross_service(edges: DataFrame, services: DataFrame) -> DataFrame:
    """from_service, to_service, n, files: edges (a, b) between files of different services (path, service), and in how many files they begin;
    files of no service have no such edges."""
    side = lambda end, name: services.select(F.col("path").alias(end), F.col("service").alias(name)).filter(F.col(name).isNotNull()).distinct()
    met = edges.select("a", "b").distinct().join(side("a", "from_service"), "a").join(side("b", "to_service"), "b").filter("from_service <> to_service")
    return met.groupBy("from_service", "to_service").agg(F.count(ONE).alias("n"), F.countDistinct("a").alias("files"))


def interface_fanout(calls: DataFrame, implements: DataFrame, methods: DataFrame) -> DataFrame:
    """``calls`` (caller, callee, confidence, tier, ...) and, for each call of an interface's method, one of each implementor's.

    ``implements``: interface, implementor; ``methods``: owner, method.  The one implementor that has the method makes a primary edge (0.65), several
    make low-signal ones of max(0.2, min(0.5, 0.6 / n)).  ``fanout`` is n, null for the calls as they were.
    """
    has = implements.select("interface", F.col("implementor").alias("owner")).distinct().join(methods.select("owner", "method").distinct(), "owner")
    n = has.groupBy("interface", "method").agg(F.count(ONE).alias("fanout"))
    target = has.join(n, ["interface", "method"]).select(F.concat_ws(".", "interface", "method").alias("callee"), F.concat_ws(".", "owner", "method").alias("_to"), "fanout")
    one = F.col("fanout") == 1
    made = calls.join(target, "callee").withColumns({"callee": F.col("_to"), "tier": F.when(one, "primary").otherwise("low_signal"), "confidence": F.when(one, 0.65).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(0.5), 0.6 / F.col("fanout"))))})
    return calls.withColumn("fanout", F.lit(None).cast("bigint")).select(*calls.columns, "fanout").union(made.select(*calls.columns, "fanout"))
