"""Patch review: diff statistics, hunk risk, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECRET = r"(?i)(password|secret|api[_-]?key|token)\s*[:=]"
SQL_CONCAT = r"(?i)(select|insert|update|delete)\s.*\+"


def diff_stats(lines: DataFrame, file: str, line: str) -> DataFrame:
    """n_lines, added, removed, n_files of diff lines; file headers are no changes."""
    head = F.col(line).rlike(r"^(\+\+\+|---) [ab/]")
    return lines.filter(~head).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col(line).startswith("+")).alias("added"), F.count_if(F.col(line).startswith("-")).alias("removed"), F.countDistinct(file).alias("n_files"))


def risk_score(text: Column, changed: Column) -> Column:
    """Secret-like text 120, SQL put together from strings 90, and a point a changed line up to 30."""
    return F.when(text.rlike(SECRET), 120).otherwise(0) + F.when(text.rlike(SQL_CONCAT), 90).otherwise(0) + F.least(F.lit(30), changed)


def risk_band(score: Column) -> Column:
    return F.when(score >= 160, "critical").when(score >= 90, "high").when(score >= 40, "medium").otherwise("low")


def coverage(expected: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    """expected, reviewed, ratio, complete."""
    both = expected.select(key).distinct().join(reviewed.select(key, F.lit(1).alias("r")).distinct(), key, "left")
    out = both.agg(F.count(F.lit(1)).alias("expected"), F.count("r").alias("reviewed"))
    return out.select("expected", "reviewed", F.round(F.col("reviewed") / F.greatest("expected", F.lit(1)), 3).alias("ratio"), (F.col("expected") == F.col("reviewed")).alias("complete"))


#: What a hunk's kinds weigh.
KINDS = {"security": 100, "sql": 85, "endpoint": 75, "contract": 65, "error-handling": 55, "config": 45, "debug-output": 35, "test": 10}
#: Patterns of command execution, assertions, values that look secret, SQL put together from strings.
EXEC = r"\b(Runtime\.getRuntime\(\)\.exec|new\s+ProcessBuilder|child_process\.exec|shell:\s*true)\b"
ASSERTS = r"\b(assert|expect|verify|shouldThrow|assertThrows)\b"
SECRET_VALUE = r"""(?i)\b(password|passwd|secret|token|api[_-]?key|private[_-]?key|credential)\b\s*[:=]\s*["'][^"']{6,}["']"""
SQL_TEXT = r"""(?is)["'`]\s*(select|insert|update|delete)\b.{0,160}\+\s*|\+\s*["'`].{0,80}\b(where|and|or|from)\b"""
TEST_FILE = r"(?i)(^|/)(test|tests|__tests__)/|\.(test|spec)\.[^/]+$|tests?\.java$"
CONFIG_FILE = r"(?i)\.(ya?ml|properties|json|xml|toml|ini|env)$|(^|/)Dockerfile"


def hunk_kinds(file: Column, added: Column, removed: Column) -> Column:
    """The kinds of change of a hunk, from its file and its added and removed lines."""
    both = F.concat(added, F.lit("\n"), removed)
    tells = {  # fixed values: the patterns
        "config": file.rlike(CONFIG_FILE), "test": file.rlike(TEST_FILE) | both.rlike(r"\b(assert|expect|verify|@Test|describe\(|it\()\b"),
        "endpoint": both.rlike(r"@(GET|POST|PUT|PATCH|DELETE|Path|GetMapping|PostMapping|PutMapping|PatchMapping|DeleteMapping|RequestMapping)\b"),
        "contract": added.rlike(r"\b(public|export|interface|class|enum|record)\b"), "error-handling": both.rlike(r"\b(catch|throw|throws|Exception|Throwable|Error)\b"),
        "sql": both.rlike(r"(?i)\b(select|insert|update|delete|where)\b"), "security": both.rlike(r"(?i)\b(auth|permission|role|token|secret|password|credential|api[_-]?key)\b"),
        "debug-output": added.rlike(r"\b(console\.log|System\.out|printStackTrace|debugger)\b"),
    }
    return F.array_compact(F.array(*(F.when(c, k) for k, c in tells.items())))


def hunk_risk(hunks: DataFrame) -> DataFrame:
    """``hunks`` (file, added, removed, changed) with kinds, score and level."""
    rows = hunks.withColumn("kinds", hunk_kinds(F.col("file"), F.col("added"), F.col("removed")))
    weight = sum((F.when(F.array_contains("kinds", k), w).otherwise(0) for k, w in KINDS.items()), F.lit(0))
    added = F.col("added")
    score = weight + F.when(added.rlike(SECRET_VALUE), 120).otherwise(0) + F.when(added.rlike(SQL_TEXT), 90).otherwise(0) + F.when(added.rlike(EXEC), 100).otherwise(0) + F.least(F.lit(30), "changed")
    return rows.withColumn("score", score).withColumn("level", risk_band(F.col("score")))


def hunk_findings(hunks: DataFrame, security: bool = False) -> DataFrame:
    """rule, priority, confidence, file: what a hunk (file, added, removed) says against itself, each rule once a file."""
    added, removed = F.col("added"), F.col("removed")
    grave = "P0" if security else "P1"
    rules = (  # fixed values: priorities, confidences and patterns
        ("secret", "P0", 0.82, added.rlike(SECRET_VALUE)), ("command-exec", grave, 0.76, added.rlike(EXEC)), ("broad-catch", "P1", 0.68, added.rlike(r"\bcatch\s*\(\s*(Exception|Throwable|Error)\b")),
        ("debug-output", "P2", 0.78, added.rlike(r"\b(console\.log|System\.out|printStackTrace|debugger)\b")), ("removed-assertion", "P1", 0.72, removed.rlike(ASSERTS) & ~added.rlike(ASSERTS)), ("sql-concat", grave, 0.7, added.rlike(SQL_TEXT)),
    )
    hits = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(p).alias("priority"), F.lit(s).alias("confidence"))) for n, p, s, c in rules)))
    return hunks.select("file", F.explode(hits).alias("x")).select("x.*", "file").distinct()


def priority_counts(findings: DataFrame) -> DataFrame:
    """priority, n of findings (id, priority), each id once."""
    return findings.dropDuplicates(["id"]).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


def stale_callers(changed: DataFrame, calls: DataFrame, files: DataFrame, most: int = 5) -> DataFrame:
    """fq_name, caller_count, callers: calls of a changed symbol (fq_name, callee) from files (file) that do not change."""
    from .relational import rank_of, top_per_key

    out = calls.join(files.select("file").distinct(), "file", "left_anti").join(changed, "callee")
    n = out.groupBy("fq_name").agg(F.count(F.lit(1)).alias("caller_count"))
    first = top_per_key(out, ["fq_name"], [rank_of("tier", ("provider", "primary")), F.desc("confidence"), F.col("file"), F.col("line"), F.col("caller")], most)
    first = first.groupBy("fq_name").agg(F.sort_array(F.collect_list(F.struct("rn", F.concat("caller", F.lit("@"), "file", F.lit(":"), "line").alias("x")))).alias("r"))
    return n.join(first.select("fq_name", F.array_join(F.transform("r", lambda x: x["x"]), " ").alias("callers")), "fq_name")


#: From where on a method is long, has many parameters, a class is large, and another class is envied.
LONG, PARAMETERS, LARGE, ENVY, ENVY_RATIO = 60, 5, 25, 3, 2


def feature_envy(calls: DataFrame) -> DataFrame:
    """caller, envied, n, own: methods with ``ENVY`` calls or more into one other class, and ``ENVY_RATIO`` times those into their
    own; calls of the standard library don't count."""
    from .filters import library_call

    segment = lambda c: F.element_at(F.split(F.regexp_replace(c, r"\([^)]*\)$", ""), r"\."), -2)
    owned = calls.filter(F.contains("callee", F.lit(".")) & ~library_call(F.col("callee")))
    n = owned.groupBy("caller", segment(F.col("callee")).alias("owner")).agg(F.count(F.lit(1)).alias("n")).withColumn("is_own", F.col("owner") == segment(F.col("caller")))
    best = n.groupBy("caller").agg(F.max(F.when(F.col("is_own"), F.col("n"))).alias("own"), F.max(F.when(~F.col("is_own"), F.struct("n", "owner"))).alias("b"))
    out = best.select("caller", F.col("b.owner").alias("envied"), F.col("b.n").alias("n"), F.coalesce("own", F.lit(0)).alias("own"))
    return out.filter((F.col("n") >= ENVY) & (F.col("n") >= ENVY_RATIO * F.col("own")))


def design_findings(methods: DataFrame, calls: DataFrame, members: DataFrame) -> DataFrame:
    """rule, fq_name, n: long methods, long parameter lists, private methods (private, callee) that nothing calls, and large
    classes (``members``: a file for each method)."""
    long = methods.filter(F.col("lines") > LONG).select(F.lit("long-method").alias("rule"), "fq_name", F.col("lines").alias("n"))
    wide = methods.filter(F.col("parameters") > PARAMETERS).select(F.lit("long-parameter-list"), "fq_name", "parameters")
    dead = methods.filter("private").join(calls.select("callee"), "callee", "left_anti").select(F.lit("dead-code"), "fq_name", F.lit(0).cast("bigint"))
    large = members.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select(F.lit("large-class"), "file", "n")
    return long.union(wide).union(dead).union(large)
