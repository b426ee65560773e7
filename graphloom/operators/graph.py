"""Graph traversal by frontier joins, level by level."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame, name: str) -> DataFrame:
    """A level written to the shared checkpoint folder, so that plans don't grow with depth."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _staged(edges: DataFrame) -> DataFrame:
    return edges if edges._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" else written(edges, "edges")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, a: str = "a", b: str = "b") -> DataFrame:
    """node, depth: every node within ``depth`` edges of a seed, at its first depth; seeds have depth 0.

    Edges that are not a table of files already are written once: each level then reads them instead of making them anew.
    """
    edges = _staged(edges.select(a, b))
    seen = written(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("depth", F.lit(0)), "reach")
    front, parts = seen, [seen]
    for d in range(1, depth + 1):
        nxt = front.join(edges, front.node == edges[a]).select(F.col(b).alias("node")).distinct()
        nxt = nxt.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        front = written(nxt, "reach")
        if front.isEmpty():
            break
        parts.append(front)
        seen = seen.union(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def trace(edges: DataFrame, seeds: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    """a, b, depth, cycle: edges out of every node reached, each at its node's depth + 1; ``cycle``: it leads to a node
    that was reached no later.  A limit keeps the first edges by depth, a, b."""
    edges = _staged(edges.select("a", "b"))
    nodes = reach(edges, seeds, depth - 1)
    out = edges.join(nodes.select(F.col("node").alias("a"), (F.col("depth") + 1).alias("depth")), "a")
    out = out.join(nodes.select(F.col("node").alias("b"), F.col("depth").alias("seen")), "b", "left")
    out = out.select("a", "b", "depth", (F.coalesce(F.col("seen") < F.col("depth"), F.lit(False))).alias("cycle"))
    return out.orderBy("depth", "a", "b").limit(limit) if limit else out


def shortest_tree(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node, depth, parent: every node within ``depth`` edges (a, b) of a seed, at its first depth, and the least node of the level
    before that has an edge to it (null for seeds)."""
    edges = _staged(edges.select("a", "b").filter("a <> b"))
    kind = dict(edges.dtypes)["a"]
    seen = written(seeds.select(F.col(seeds.columns[0]).cast(kind).alias("node")).distinct().withColumns({"depth": F.lit(0), "parent": F.lit(None).cast(kind)}), "tree")
    front, out = seen, seen
    for d in range(1, depth + 1):
        nxt = front.select(F.col("node").alias("a")).join(edges, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        front = written(nxt.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), "parent"), "tree")
        if front.isEmpty():
            break
        out = seen = seen.union(front)
    return out


def paths_to(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """target, depth, path: for each target in a ``shortest_tree`` the nodes from its seed to it, by walking back level by level.

    All targets walk at once: a level is one join of as many rows as there are targets.
    """
    now = tree.join(targets.select(F.col(targets.columns[0]).alias("node")).distinct(), "node").select(F.col("node").alias("target"), "depth", "parent", F.array("node").alias("path"))
    deepest = now.agg(F.max("depth")).first()[0] or 0
    for _ in range(deepest):
        up = tree.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        moved = now.join(up, "parent", "left")
        on = F.col("parent").isNotNull()
        now = written(moved.select("target", "depth", F.when(on, F.col("above")).alias("parent"), F.when(on, F.concat(F.array("parent"), "path")).otherwise(F.col("path")).alias("path")), "paths")
    return now.select("target", "depth", "path")


def flow_paths(edges: DataFrame, seeds: DataFrame, targets: DataFrame, depth: int = 4) -> DataFrame:
    """target, depth, path: one shortest path (of least parents) from a seed to each target within ``depth`` edges."""
    return paths_to(shortest_tree(edges, seeds, depth), targets)


def affected_tests(edges: DataFrame, roles: DataFrame, changed: DataFrame, depth: int = 4) -> DataFrame:
    """node, distance, via: tests that reach a changed file over imports (``a`` imports ``b``), and the imported file that they reach it by
    (the least of the nearest).  Traversal passes through tests; a changed test counts only if it imports such a file."""
    edges = _staged(edges.select("a", "b").filter("a <> b"))
    near = reach(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), changed, depth - 1)
    tests = roles.filter("role in ('test_source', 'mock_source')").select(F.col("node").alias("a")).distinct()
    met = edges.join(tests, "a", "left_semi").join(near.select(F.col("node").alias("b"), "depth"), "b")
    first = met.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("depth", "b")).alias("m"))
    return first.select("node", (F.col("m.depth") + 1).alias("distance"), F.col("m.b").alias("via"))


def degrees(*edges: DataFrame) -> DataFrame:
    """node, degree over the union of edge tables."""
    both = None
    for e in edges:
        x = e.select(F.explode(F.array("a", "b")).alias("node"))
        both = x if both is None else both.union(x)
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def ancestors(parent: DataFrame, depth: int | None = None) -> DataFrame:
    """child, ancestor, depth: the closure of a child-parent table, whole without ``depth``; a cycle ends where a pair comes again."""
    parent = written(parent.select("child", "parent").distinct(), "parents")
    now = parent.selectExpr("child", "parent AS ancestor", "1 AS depth")
    every, d = now, 1
    while depth is None or d < depth:
        d += 1
        nxt = now.join(parent.selectExpr("child AS ancestor", "parent AS up"), "ancestor").selectExpr("child", "up AS ancestor", f"{d} AS depth").distinct()
        nxt = written(nxt.join(every, ["child", "ancestor"], "left_anti"), "ancestors")
        if nxt.isEmpty():
            break
        now, every = nxt, every.union(nxt)
    return every


def call_chain(calls: DataFrame, start: str, depth: int = 3, per_node: int = 25, limit: int = 100) -> DataFrame:
    """level, caller, callee, file, line, confidence: calls from a method on, ``per_node`` best of each name, breadth first.

    A name stands for all callers that contain it; each is followed once.  ``calls``: of visible tiers, with ``tier_rank``.
    """
    from .relational import top_per_key
    from ..functions.text import last_segments

    spark = calls.sparkSession
    calls = written(calls.select("caller", "callee", "file", "line", "confidence", "tier_rank"), "calls")
    names = written(calls.select("caller").distinct(), "callers")
    seen = now = spark.createDataFrame([(start,)], "name string")
    out = None
    for level in range(1, depth + 1):
        # names are few (at most limit * per_node a level); callers meet them by substring
        met = names.join(F.broadcast(now), F.contains(F.lower("caller"), F.lower("name"))).select("caller", "name")
        found = top_per_key(met.join(calls, "caller"), ["name"], [F.col("tier_rank"), F.desc("confidence"), F.col("line"), F.col("file"), F.col("caller"), F.col("callee")], per_node)
        found = written(found.select(F.lit(level).alias("level"), "name", "rn", "caller", "callee", "file", "line", "confidence").orderBy("name", "rn").limit(limit), "chain")
        out = found if out is None else out.union(found)
        nxt = found.select(last_segments(F.col("callee")).alias("name")).distinct().join(seen, "name", "left_anti")
        now = written(nxt, "names")
        if now.isEmpty():
            break
        seen = seen.union(now)
    return out.orderBy("level", "name", "rn").limit(limit).select("level", "caller", "callee", "file", "line", "confidence")


def seeds_of(paths: DataFrame, target: str, most: int = 100) -> DataFrame:
    """path: files that a target names: exactly, else by suffix, else by a part, the first ``most``."""
    low = F.lower("path")
    rank = F.when(F.col("path") == target, 0).when(F.col("path").endswith("/" + target), 1).when(F.contains(low, F.lit(target.lower())), 2)
    found = paths.select("path", rank.alias("rank")).filter("rank IS NOT NULL")
    best = found.agg(F.min("rank").alias("rank"))
    return found.join(F.broadcast(best), "rank").orderBy("path").limit(most).select("path")  # one row


def trace_both(edges: DataFrame, seeds: DataFrame, depth: int = 2, direction: str = "both", roles: DataFrame | None = None, limit: int = 200) -> DataFrame:
    """direction, a, b, depth, cycle: the first edges by depth in the asked directions, neighbours of known hidden roles left out."""
    out = None
    for way, df in (("dependencies", edges.select("a", "b")), ("dependents", edges.select(F.col("b").alias("a"), F.col("a").alias("b")))):
        if direction in (way, "both"):
            if roles is not None:
                hidden = roles.filter(F.col("role").isin("test_source", "generated", "mock_source")).select(F.col("node").alias("b"))
                df = df.join(hidden, "b", "left_anti").select("a", "b")
            part = trace(df, seeds, depth).select(F.lit(way).alias("direction"), "a", "b", "depth", "cycle")
            out = part if out is None else out.union(part)
    return out.orderBy("depth", "direction", "a", "b").limit(limit)


def trace_groups(edges: DataFrame, files: int = 8, samples: int = 3) -> DataFrame:
    """direction, depth, n, files (by how often they occur), samples: a trace's edges in groups."""
    from .relational import top_per_key

    keys = ["direction", "depth"]
    n = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ends = edges.select(*keys, F.explode(F.array("a", "b")).alias("file")).groupBy(*keys, "file").agg(F.count(F.lit(1)).alias("c"))
    listed = lambda df, name: df.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "x"))), lambda s: s["x"]), " ").alias(name))
    best = top_per_key(ends, keys, [F.desc("c"), F.col("file")], files).withColumn("x", F.col("file").cast("string"))
    few = top_per_key(edges, keys, [F.col("a"), F.col("b")], samples).withColumn("x", F.concat_ws(">", "a", "b"))
    return n.join(listed(best, "files"), keys).join(listed(few, "samples"), keys)


def named_calls(calls: DataFrame, symbol: str, end: str, limit: int) -> DataFrame:
    """Calls of whose ``end`` (caller: callees of a symbol; callee: its callers) one of the symbol's names is all (``pass`` 0),
    then those that contain one, by tier, confidence and place."""
    from .filters import named_edges
    from .relational import rank_of
    from .resolution import lookup_terms

    found = named_edges(calls, lookup_terms(symbol), (end,))
    order = [F.col("pass"), rank_of("tier", ("provider", "primary")), F.desc("confidence"), F.col("file"), F.col("line"), F.col("caller"), F.col("callee")]
    return found.orderBy(*order).limit(limit)


def neighbours(edges: DataFrame, seeds: DataFrame, files: DataFrame, language: str | None = None) -> DataFrame:
    """file, hits: files (file, role, language) of the main source one edge from a seed, with how many edges lead there."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(seeds.select(F.col("file").alias("a")).distinct(), "a", "left_semi").join(seeds.select(F.col("file").alias("b")).distinct(), "b", "left_anti")
    own = files.filter("role = 'main_source'")
    if language:
        own = own.filter(F.col("language").isNull() | F.col("language").isin("", language))
    return near.groupBy(F.col("b").alias("file")).agg(F.count(F.lit(1)).alias("hits")).join(own.select("file"), "file", "left_semi")


def central_files(files: DataFrame, edges: DataFrame, words: list[str], least: int = 2) -> DataFrame:
    """path, coverage, in_degree: files whose basename has ``least`` words of a query or more, the most imported ones first."""
    from ..functions.text import base_name, word_parts

    asked = F.array(*(F.lit(w) for w in dict.fromkeys(words) if len(w) >= 3))
    own = F.array_distinct(word_parts(F.regexp_replace(base_name(F.col("path")), r"\.[^./]+$", "")))
    found = files.select("path", F.size(F.array_intersect(own, asked)).alias("coverage")).filter(F.col("coverage") >= least)
    n = edges.groupBy(F.col("b").alias("path")).agg(F.countDistinct("a").alias("in_degree"))
    return found.join(n, "path", "left").fillna(0, ["in_degree"]).orderBy(F.desc("coverage"), F.desc("in_degree"), "path")
