"""Test selection for changed paths, and the measures of retrieval, selection and release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters
from .graph import affected_tests, written


def changed_paths(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Changes (path, status) with ``decision``: ignored, traced, or why all tests run (deleted, configuration, unknown)."""
    rows = changes.join(files.select("path", "role"), "path", "left")
    decision = (
        F.when(filters.ignorable(F.col("path")), "ignored").when(F.col("status").startswith("D"), "deleted").when(F.col("role").isin("build_config", "resource_config"), "configuration")
        .when(filters.runs_all(F.col("path")), "configuration").when(F.col("role").isNull(), "unknown").otherwise("traced")
    )
    return rows.withColumn("decision", decision)


def selected_tests(changes: DataFrame, files: DataFrame, edges: DataFrame, depth: int = 4, limit: int = 200) -> DataFrame:
    """path, distance, via: the ``limit`` nearest tests that reach a traced change, and changed tests that none of them is, at 0 by themselves."""
    traced = changed_paths(changes, files).filter("decision = 'traced'")
    reached = affected_tests(edges, files.selectExpr("path AS node", "role"), traced.selectExpr("path AS node"), depth)
    near = written(reached.selectExpr("node AS path", "distance", "via").orderBy("distance", "path").limit(limit), "tests")
    own = traced.filter(F.col("role").isin("test_source", "mock_source")).selectExpr("path", "0 AS distance", "path AS via").distinct()
    return near.union(own.join(near, "path", "left_anti"))


def selection_verdict(changes: DataFrame, files: DataFrame, tests: DataFrame, limit: int = 200) -> DataFrame:
    """One row: changes by decision, tests, whether all must run, and the share of tests left out."""
    d = changed_paths(changes, files).agg(*(F.count_if(F.col("decision") == x).alias(x) for x in ("ignored", "traced", "deleted", "configuration", "unknown")))
    t = tests.agg(F.count(F.lit(1)).alias("n_tests"))
    n = files.agg(F.count_if(F.col("role") == "test_source").alias("n_all"))
    one = F.lit(1).alias("one")  # three single rows side by side
    out = d.select("*", one).join(t.select("*", one), "one").join(n.select("*", one), "one").drop("one")
    return out.withColumns({"run_all": (F.col("deleted") + F.col("configuration") + F.col("unknown") > 0) | (F.col("n_tests") >= limit), "reduction": F.round(1 - F.col("n_tests") / F.greatest("n_all", F.lit(1)), 3)})


def recall_by_task(expected: DataFrame, found: DataFrame, depths: tuple[int, ...] = (6, 10, 15)) -> DataFrame:
    """task, need, recall (of all found), all_found, and recall at each depth, from (task, file) and (task, file, place)."""
    hit = expected.distinct().join(found.groupBy("task", "file").agg(F.min("place").alias("place")), ["task", "file"], "left")
    out = hit.groupBy("task").agg(F.count(F.lit(1)).alias("need"), F.count("place").alias("hits"), *(F.count_if(F.col("place") <= d).alias(f"h{d}") for d in depths))
    share = lambda c: F.round(F.col(c) / F.col("need"), 2)
    return out.select("task", "need", share("hits").alias("recall"), (F.col("hits") == F.col("need")).alias("all_found"), *(share(f"h{d}").alias(f"recall_at_{d}") for d in depths))


def recall_summary(per_task: DataFrame) -> DataFrame:
    return per_task.agg(F.count(F.lit(1)).alias("tasks"), F.count_if("all_found").alias("all_found"), F.round(F.avg("recall"), 2).alias("avg_recall"), F.round(F.count_if(~F.col("all_found")) / F.count(F.lit(1)), 2).alias("gap"))


def direct_test_recall(edges: DataFrame, roles: DataFrame, depth: int = 2) -> DataFrame:
    """changed, n_direct, n_selected, recall: for each file that a test imports, whether selection finds those tests.

    ``edges``: a imports b; all files are followed at once, as (changed, node) pairs, level by level.
    """
    test = roles.filter("role = 'test_source'").select(F.col("node"))
    direct = edges.join(test.toDF("a"), "a", "left_semi").join(test.toDF("b"), "b", "left_anti").select(F.col("b").alias("changed"), F.col("a").alias("test")).distinct()
    now = direct.select("changed", F.col("changed").alias("node")).distinct()
    every = now.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        now = now.join(edges.select(F.col("b").alias("node"), F.col("a").alias("up")), "node").select("changed", F.col("up").alias("node")).distinct()
        every = every.union(now.withColumn("depth", F.lit(d)))
    picked = every.filter("depth > 0 AND node <> changed").select("changed", F.col("node").alias("test")).distinct().join(test.toDF("test"), "test", "left_semi")
    n = picked.groupBy("changed").agg(F.count(F.lit(1)).alias("n_selected"))
    hit = direct.join(picked.withColumn("hit", F.lit(1)), ["changed", "test"], "left").groupBy("changed").agg(F.count(F.lit(1)).alias("n_direct"), F.count("hit").alias("hits"))
    return hit.join(n, "changed", "left").select("changed", "n_direct", F.coalesce("n_selected", F.lit(0)).alias("n_selected"), F.round(F.col("hits") / F.col("n_direct"), 3).alias("recall"))


#: The release gate's checks as (name, how it compares, bound).
GATE = (("tokens_d_vs_b", ">=", 20), ("tokens_d_vs_a", ">=", 30), ("tokens_c_vs_b", "<=", 10), ("wall_d_vs_b", "<=", 30), ("stale_detection", "=", 100), ("advertised_schema", "<=", 600), ("index_regression", "<=", 5), ("query_regression", "<=", 5))


def release_gate(arms: DataFrame, rates: DataFrame) -> DataFrame:
    """check, value, passed: ``arms`` (arm A to D; false_answerable, file_recall, method_recall, critical_misses, tokens,
    wall_ms) against each other, and one row of ``rates`` (stale_detection, advertised_schema, index_regression, query_regression)."""
    metrics = ("false_answerable", "file_recall", "method_recall", "critical_misses", "tokens", "wall_ms")
    side = arms.agg(*(F.max(F.when(F.col("arm") == a, F.col(m))).cast("double").alias(f"{m}_{a.lower()}") for a in "ABCD" for m in metrics))
    row = side.select("*", F.lit(1).alias("one")).join(rates.select("*", F.lit(1).alias("one")), "one")
    less = lambda a, b: F.when(F.col(a) > 0, (F.col(a) - F.col(b)) / F.col(a) * 100)
    more = lambda a, b: F.when(F.col(a) > 0, (F.col(b) - F.col(a)) / F.col(a) * 100)
    row = row.withColumns({"tokens_d_vs_b": less("tokens_b", "tokens_d"), "tokens_d_vs_a": less("tokens_a", "tokens_d"), "tokens_c_vs_b": more("tokens_b", "tokens_c"), "wall_d_vs_b": more("wall_ms_b", "wall_ms_d")})
    checks = [(f"false_answerable_{a}", F.col(f"false_answerable_{a}"), F.col(f"false_answerable_{a}") == 0) for a in "abcd"]
    for a in "cd":
        checks += [(f"{m}_{a}", F.col(f"{m}_{a}"), F.col(f"{m}_{a}") >= F.greatest(f"{m}_a", f"{m}_b")) for m in ("file_recall", "method_recall")]
        checks.append((f"critical_misses_{a}", F.col(f"critical_misses_{a}"), F.col(f"critical_misses_{a}") == 0))
    test = {">=": lambda c, n: c >= n, "<=": lambda c, n: c <= n, "=": lambda c, n: c == n}
    checks += [(name, F.col(name), test[op](F.col(name), n)) for name, op, n in GATE]
    made = F.array(*(F.struct(F.lit(name).alias("check"), F.round(value.cast("double"), 4).alias("value"), F.coalesce(passed, F.lit(False)).alias("passed")) for name, value, passed in checks))
    return row.select(F.explode(made).alias("x")).select("x.*")
