"""Modules and hotspots: where modules begin, which files they hold, what a set of files belongs to, what is risky."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import written
from .relational import longest_prefix, top_per_key

#: Files that mark a module's root.
MARKERS = r"(?i)(^|/)(pom\.xml|build\.gradle|settings\.gradle|package\.json|go\.mod|Dockerfile|docker-compose\.ya?ml)$"


def folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def source_root(path: Column) -> Column:
    """The folder above ``src``, else the first folder."""
    return F.when(path.rlike("(^|/)src/"), F.regexp_replace(path, "/?(?:^|(?<=/))src/.*$", "")).otherwise(F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise(""))


def module_roots(files: DataFrame, symbols: DataFrame, endpoints: DataFrame) -> DataFrame:
    """root, evidence: folders with a build marker, of an application class or of an endpoint; the first folders where there is
    nothing of these."""
    marked = files.filter(F.col("path").rlike(MARKERS)).select(folder(F.col("path")).alias("root"), F.lit("marker").alias("evidence"))
    started = symbols.filter("framework_role = 'spring:application'").select(source_root(F.col("file")).alias("root"), F.lit("application").alias("evidence"))
    served = endpoints.select(source_root(F.col("file")).alias("root"), F.lit("endpoint").alias("evidence"))
    found = marked.union(started).union(served).distinct()
    none = found.filter("root <> ''").agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    rest = files.filter(F.contains("path", F.lit("/"))).select(F.substring_index("path", "/", 1).alias("root"), F.lit("top-level").alias("evidence")).distinct().join(F.broadcast(none)).drop("n")  # one row or none
    return found.union(rest).groupBy("root").agg(F.array_join(F.sort_array(F.collect_set("evidence")), ",").alias("evidence"))


def module_of(files: DataFrame, roots: DataFrame) -> DataFrame:
    """path, module: the longest root above a file; the workspace (empty) where there is none."""
    found = longest_prefix(files, roots.filter("root <> ''"))
    return files.select("path").join(found, "path", "left").select("path", F.coalesce("root", F.lit("")).alias("module"))


def module_rollup(files: DataFrame, symbols: DataFrame, endpoints: DataFrame, top: int = 6) -> DataFrame:
    """module, n_files, n_symbols, n_endpoints, top_files (by 100 points an endpoint and one a symbol) from (path, module)."""
    n = lambda df, name: df.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias(name))
    rows = files.join(n(symbols, "s"), "path", "left").join(n(endpoints, "e"), "path", "left").fillna(0, ["s", "e"])
    first = top_per_key(rows, ["module"], [F.desc(F.col("e") * 100 + F.col("s")), F.col("path")], top)
    names = first.groupBy("module").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "path"))), lambda x: x["path"]), " ").alias("top_files"))
    return rows.groupBy("module").agg(F.count(F.lit(1)).alias("n_files"), F.sum("s").alias("n_symbols"), F.sum("e").alias("n_endpoints")).join(names, "module")


def hotspots(files: DataFrame, dependencies: DataFrame, calls: DataFrame, symbols: DataFrame, endpoints: DataFrame) -> DataFrame:
    """path, n_in, n_out, n_calls, n_symbols, n_endpoints, weight (the order), risk (symbols count 100 at most), level.

    The five counts are one union and one aggregate by file, so that there is one shuffle and no join but that with the files.
    """
    kinds = ("n_in", "n_out", "n_calls", "n_symbols", "n_endpoints")
    parts = [
        dependencies.select(F.explode(F.array(F.struct(F.col("b").alias("path"), F.lit("n_in").alias("kind")), F.struct(F.col("a").alias("path"), F.lit("n_out").alias("kind")))).alias("x")).select("x.*"),
        calls.select(F.col("file").alias("path"), F.lit("n_calls").alias("kind")), symbols.select(F.col("file").alias("path"), F.lit("n_symbols").alias("kind")), endpoints.select(F.col("file").alias("path"), F.lit("n_endpoints").alias("kind")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    counts = every.groupBy("path").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    out = files.select("path").join(counts, "path", "left").fillna(0)
    out = out.withColumn("weight", F.expr("3 * n_in + 2 * n_out + 2 * n_calls + 25 * n_endpoints + n_symbols")).withColumn("risk", F.expr("3 * n_in + 2 * n_out + 2 * n_calls + 25 * n_endpoints + least(n_symbols, 100)"))
    return out.withColumn("level", F.when(F.col("risk") >= 80, "high").when(F.col("risk") >= 25, "medium").otherwise("low"))


def context_of(files: DataFrame, modules: DataFrame, edges: DataFrame, limit: int = 12) -> DataFrame:
    """section, key, n: the modules of ``files`` (path), edges at them, and bridges (modules at the other end).

    ``modules``: path, module; ``edges``: source, target, edge_count between modules.
    """
    own = modules.join(files.select("path").distinct(), "path", "left_semi").groupBy("module").agg(F.count(F.lit(1)).alias("n")).orderBy("module").limit(limit)
    touch = edges.join(own.select(F.col("module").alias("source"), F.lit(True).alias("s")), "source", "left").join(own.select(F.col("module").alias("target"), F.lit(True).alias("t")), "target", "left")
    touch = touch.filter("s OR t").orderBy(F.desc("edge_count"), "source", "target").limit(3 * limit)
    far = touch.select(F.explode(F.array(F.when(F.col("s").isNull(), F.col("source")), F.when(F.col("t").isNull(), F.col("target")))).alias("key")).filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy("key").limit(limit)
    out = own.select(F.lit("module").alias("section"), F.col("module").alias("key"), "n").union(touch.select(F.lit("edge"), F.concat_ws(" > ", "source", "target"), "edge_count"))
    return out.union(far.select(F.lit("bridge"), "key", "n"))


def siblings(files: DataFrame, modules: DataFrame, limit: int = 12) -> DataFrame:
    """module, path: other files of the modules of ``files``, the first ``limit`` of all: what an empty trace shows instead."""
    own = modules.join(files.select("path").distinct(), "path", "left_semi").select("module").distinct()
    return modules.join(own, "module", "left_semi").join(files.select("path").distinct(), "path", "left_anti").orderBy("path").limit(limit).select("module", "path")


def degree_of_files(dependencies: DataFrame, calls: DataFrame) -> DataFrame:
    """node, degree: dependency edges at either end and calls made in a file."""
    ends = dependencies.select(F.explode(F.array("a", "b")).alias("node")).union(calls.select(F.col("file").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def within_caps(nodes: DataFrame, edges: DataFrame, most_nodes: int = 800, most_edges: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The best nodes (id, score), each once with its best score, and the best edges (source, target, score) between them."""
    kept = nodes.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(most_nodes)
    inside = edges.groupBy("source", "target").agg(F.max("score").alias("score"))
    inside = inside.join(kept.select(F.col("id").alias("source")), "source", "left_semi").join(kept.select(F.col("id").alias("target")), "target", "left_semi")
    return kept, inside.orderBy(F.desc("score"), "source", "target").limit(most_edges)


def ordered_distinct(rows: DataFrame, key: str, place: str) -> DataFrame:
    """Each key once with its rank in the order of first places.

    Keys are dealt to ranges of places; a rank is the keys of earlier ranges plus the place in its own, so no task orders all keys.
    """
    first = rows.groupBy(key).agg(F.min(place).alias(place)).repartitionByRange(place, key).withColumn("_range", F.spark_partition_id())
    first = written(first, "ranges")  # a range must stay what it was when it was counted
    count = first.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    earlier = count.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(place, key))
    return first.withColumn("_own", own).join(earlier, "_range").withColumn("rank", (F.col("_before") + F.col("_own")).cast("bigint")).drop("_range", "_own", "_before")
