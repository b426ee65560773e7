"""Packets for a task: mapper statements with the methods and callers that run them, what a change breaks of its plan, sections composed of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import last_segments
from .packs import section


def mapper_flow(statements: DataFrame, methods: DataFrame, calls: DataFrame) -> DataFrame:
    """namespace, id, kind, method, caller, file, line: SQL statements of mapper files (namespace, id, kind) with the interface method of that
    name (fq_name, owner, name) and each call (caller, callee, file, line) of it.

    A call names the method by its owner's last segment or whole.  Statements without a method, and methods without a call, come with nulls.
    """
    own = methods.select(F.col("owner").alias("namespace"), F.col("name").alias("id"), F.col("fq_name").alias("method")).distinct()
    rows = statements.select("namespace", "id", "kind").distinct().join(own, ["namespace", "id"], "left")
    simple = F.concat_ws(".", F.substring_index("namespace", ".", -1), "id")
    names = rows.filter("method is not null").select("namespace", "id", F.explode(F.array_distinct(F.array(simple, F.col("method")))).alias("callee"))
    run = names.join(calls.select("callee", "caller", "file", "line"), "callee").select("namespace", "id", "caller", "file", "line").distinct()
    return rows.join(run, ["namespace", "id"], "left")


def mapper_gaps(statements: DataFrame, methods: DataFrame) -> DataFrame:
    """gap, namespace, id: statements that no interface method runs, and methods of mapper interfaces without a statement."""
    s, m = statements.select("namespace", "id").distinct(), methods.select(F.col("owner").alias("namespace"), F.col("name").alias("id")).distinct()
    lost = s.join(m, ["namespace", "id"], "left_anti").select(F.lit("statement without method").alias("gap"), "namespace", "id")
    of = m.join(s.select("namespace").distinct(), "namespace", "left_semi")
    return lost.union(of.join(s, ["namespace", "id"], "left_anti").select(F.lit("method without statement"), "namespace", "id"))


def scope_breaks(plan: DataFrame, changes: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """task, invariant, path: what a change breaks of its plan.

    ``plan``: task, path, part (allowed, required or frozen; an allowed path ending in / is a folder); ``changes``: task, path; ``edges``: a imports b;
    ``tests``: path.  Invariants: a change is in scope; what is required is changed; what is frozen is not; a changed file that is no test is
    imported by a test.
    """
    row = lambda df, name: df.select("task", F.lit(name).alias("invariant"), "path")
    done = changes.select("task", "path").distinct()
    part = lambda p: plan.filter(F.col("part") == p).select("task", "path").distinct()
    # a path's folders, so that folders of the plan meet it by an equi-join
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    places = done.select("task", "path", F.explode(F.array_distinct(F.concat(F.array("path"), up))).alias("place"))
    inside = places.join(part("allowed").withColumnRenamed("path", "place"), ["task", "place"], "left_semi").select("task", "path").distinct()
    limited = done.join(part("allowed").select("task").distinct(), "task", "left_semi")  # a task without a scope may change anything
    tested = edges.join(tests.select(F.col("path").alias("a")), "a", "left_semi").select(F.col("b").alias("path")).distinct()
    main = done.join(tests.select("path").distinct(), "path", "left_anti")
    out = row(limited.join(inside, ["task", "path"], "left_anti"), "out of scope")
    out = out.union(row(part("required").join(done, ["task", "path"], "left_anti"), "required but unchanged"))
    out = out.union(row(done.join(part("frozen"), ["task", "path"], "left_semi"), "frozen but changed"))
    return out.union(row(main.join(tested, "path", "left_anti"), "no test imports it"))


def context_packet(flow: DataFrame, gaps: DataFrame, callers: DataFrame, most: int = 20) -> DataFrame:
    """section, place, key, value: a task's mapper statements, the callers that reach them, gaps, and their callers' callers."""
    run = flow.filter("caller is not null")
    up = callers.join(run.select(last_segments(F.col("caller"), 2).alias("callee")).distinct(), "callee").select("caller", "callee").distinct()
    parts = [
        section(flow.select(F.concat_ws(".", "namespace", "id").alias("k"), F.col("kind").alias("v")).distinct(), "statements", "k", "v", [F.col("k"), F.col("v")], most),
        section(run.select("caller", F.concat_ws(".", "namespace", "id").alias("k")).distinct(), "callers", "caller", "k", [F.col("caller"), F.col("k")], most),
        section(up, "entry", "caller", "callee", [F.col("caller"), F.col("callee")], most),
        section(gaps.select(F.concat_ws(".", "namespace", "id").alias("k"), "gap"), "gaps", "k", "gap", [F.col("k"), F.col("gap")], most),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def change_packet(breaks: DataFrame, impact: DataFrame, task: str, most: int = 20) -> DataFrame:
    """section, place, key, value: what a task's change breaks, and the paths that it reaches (path, distance)."""
    own = breaks.filter(F.col("task") == task)
    broken = section(own, "invariants", "path", "invariant", [F.col("invariant"), F.col("path")], most)
    return broken.union(section(impact, "impact", "path", "distance", [F.col("distance"), F.col("path")], most))
