"""Filters, joins, aggregates, windows, sorts and set operations over code-intelligence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VISIBLE_TIERS = ("primary", "provider")
#: Roles that a search hides unless asked for.
HIDDEN_ROLES = ("test_source", "generated", "mock_source")


def visible_calls(calls: DataFrame, tier: str = "tier") -> DataFrame:
    return calls.filter(F.col(tier).isin(*VISIBLE_TIERS))


def visible_files(files: DataFrame, role: str = "role", show: tuple[str, ...] = ()) -> DataFrame:
    """Files of roles that are not hidden; a file of unknown role passes."""
    hidden = [r for r in HIDDEN_ROLES if r not in show]
    return files.filter(F.col(role).isNull() | ~F.col(role).isin(*hidden)) if hidden else files


def rank_of(c: str | Column, order: tuple[str, ...]) -> Column:
    """Place of a value in a priority list; others come last."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.when(c == order[0], 0)
    for k, v in enumerate(order[1:], 1):
        out = out.when(c == v, k)
    return out.otherwise(len(order))


def contains_text(c: str, needle: str) -> Column:
    """Case-insensitive substring; wildcards in the needle are plain text."""
    return F.contains(F.lower(F.col(c)), F.lit(needle.lower()))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int | None) -> DataFrame:
    """The first n rows of each key by a total order (None: all)."""
    ranked = df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked if n is None else ranked.filter(F.col("rn") <= n)


def left_out(rows: DataFrame, keys: list[str], most: int | None) -> DataFrame:
    """The keys with n, the rows of each, and left_out, how many of them a limit of ``most`` a key drops."""
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(n.alias("n"), F.greatest(n - most, F.lit(0)).alias("left_out") if most is not None else F.lit(0).cast("bigint").alias("left_out"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset+1 to offset+limit of a total order (top-k, no full sort)."""
    return df.orderBy(*order).limit(offset + limit).orderBy(*order).offset(offset)


def facets(df: DataFrame, dims: list[str]) -> DataFrame:
    """dim, value, n: counts of each value of each dimension, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dims]))
    return df.select(pairs.alias("x")).groupBy("x.dim", "x.value").agg(F.count(F.lit(1)).alias("n"))


def unique_match(names: DataFrame, key: str, value: str) -> DataFrame:
    """key, value of the keys that one row has."""
    return names.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.min(value).alias(value)).filter("c = 1").drop("c")


#: Lines of a bucket: a span is in as many buckets as it touches, a point in one.
BUCKET = 64


def containing(points: DataFrame, spans: DataFrame, file: str = "file", at: str = "at", kinds: tuple[str, ...] = ("method", "field", "class", "interface", "enum")) -> DataFrame:
    """For each point (file, at) the span that holds it: by kind, then the smallest, then the latest; where none does,
    the span nearest to it.

    Spans and points meet by file and bucket of lines, so that a large file makes no product of its points and spans.  What is
    left over finds its neighbours in one pass over the file's span starts.
    """
    points = points.select(file, at).distinct()
    spans = spans.select(file, "fq_name", "kind", "line", F.coalesce("end_line", "line").alias("end_line"))
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    dealt = spans.filter("end_line >= line").withColumn("_b", F.explode(F.sequence(bucket("line"), bucket("end_line"))))
    met = points.withColumn("_b", bucket(at)).join(dealt, [file, "_b"]).filter((F.col("line") <= F.col(at)) & (F.col("end_line") >= F.col(at)))
    best = F.min(F.struct(rank_of("kind", kinds).alias("r"), (F.col("end_line") - F.col("line")).alias("w"), (-F.col("line")).alias("l"), "fq_name", "kind")).alias("m")
    inside = met.groupBy(file, at).agg(best).select(file, at, "m.fq_name", "m.kind", F.lit("containing").alias("how"))
    left = points.join(inside, [file, at], "left_anti")
    starts = spans.groupBy(file, "line").agg(F.min(F.struct("fq_name", "kind")).alias("s"))
    marks = starts.select(file, F.col("line").alias("_at"), F.lit(0).alias("_p"), F.struct("line", "s.fq_name", "s.kind").alias("_s"))
    marks = marks.union(left.select(file, F.col(at).alias("_at"), F.lit(1), F.lit(None).cast(marks.schema["_s"].dataType)))
    w = W.partitionBy(file).orderBy("_at", "_p")
    marks = marks.withColumn("_before", F.last("_s", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_after", F.first("_s", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    gap = lambda c: F.abs(F.col(f"{c}.line") - F.col("_at"))
    near = F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.col("_after"))
    found = marks.filter("_p = 1").withColumn("n", near).filter("n IS NOT NULL")
    return inside.union(found.select(file, F.col("_at").alias(at), "n.fq_name", "n.kind", F.lit("nearest").alias("how")))


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Each path with the longest root that is one of its folders: an equi-join on the path's folders."""
    parts = F.split(F.col(path), "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    found = paths.select(path, F.explode(folders).alias(root)).join(roots.select(root).distinct(), root)
    return found.groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))


def snapshot_diff(now: DataFrame, before: DataFrame, key: str = "path", digest: str = "blob_hash") -> DataFrame:
    """key, change: added, modified, deleted or unchanged."""
    both = now.select(key, F.col(digest).alias("new")).join(before.select(key, F.col(digest).alias("old")), key, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return both.select(key, change.alias("change"))


def carry_forward(facts: DataFrame, old: DataFrame, new: DataFrame, key: str = "path", digest: str = "blob_hash") -> DataFrame:
    """Facts of files whose content did not change."""
    same = old.select(key, digest).join(new.select(key, digest), [key, digest])
    return facts.join(same.select(key), key, "left_semi")


def right_size(rows: DataFrame, keys: list[str], score: str, keep_ratio: float = 0.8, min_keep: int = 1, tie: str = "id") -> DataFrame:
    """Rows near the top, with their rank ``rn``: the anchor is the second score where the first is 1.4 times as large or more.

    The two best scores of each key come from an aggregate of at most two rows a task; only rows that stay are ranked.
    """
    best = F.struct(F.coalesce(F.col(score), F.lit(0.0)).alias("s"), F.col(tie).alias("t"))
    top = rows.groupBy(*keys).agg(F.max_by(best, best).alias("a"), F.count(F.lit(1)).alias("n"))
    second = rows.join(top, keys).filter(~(F.col("a.t").eqNullSafe(F.col(tie)))).groupBy(*keys).agg(F.max(F.coalesce(F.col(score), F.lit(0.0))).alias("s2"))
    marks = top.join(second, keys, "left").select(*keys, F.col("a.s").alias("s1"), "s2", "n")
    anchor = F.when((F.col("s2") > 0) & (F.col("s1") / F.col("s2") >= 1.4), F.col("s2")).otherwise(F.col("s1"))
    rows = rows.join(marks.withColumn("cut", anchor * keep_ratio), keys)
    near = (F.col("n") <= min_keep) | (F.col("s1") <= 0) | (F.coalesce(F.col(score), F.lit(0.0)) >= F.col("cut"))
    w = W.partitionBy(*keys).orderBy(F.desc(score), F.col(tie))
    if min_keep > 1:  # rows kept by rank alone
        return rows.withColumn("rn", F.row_number().over(w)).filter(near | (F.col("rn") <= min_keep)).drop("s1", "s2", "n", "cut")
    return rows.filter(near).withColumn("rn", F.row_number().over(w)).drop("s1", "s2", "n", "cut")


def retained(snapshots: DataFrame, workspace: str, current: str, created: str, key: str, n: int = 3) -> DataFrame:
    """Snapshots to keep: the current one and the newest, up to n a workspace."""
    return top_per_key(snapshots, [workspace], [F.desc(current), F.desc(created), F.desc(key)], n).drop("rn")


def _lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line: distinct non-trivial trimmed lines (8 characters or more, not only brackets)."""
    lines = texts.select(key, F.explode(F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.trim(x)))).alias("line"))
    return lines.filter((F.length("line") >= 8) & ~F.col("line").rlike(r"^[\[\](){};,\s]*$"))


def _line_sets(lines: DataFrame, key: str) -> DataFrame:
    """key, n, h: the number of lines and their sorted hashes."""
    return lines.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.xxhash64("line"))).alias("h"))


def line_set_members(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, representative, n_lines, class_size: each text that has non-trivial lines with the smallest key of those of the
    same line set.  ``shared_lines`` pairs representatives; members of one class share all lines, at a ratio of 1."""
    sets = _line_sets(_lines(texts, key, text), key)
    classes = sets.groupBy("h").agg(F.min(key).alias("representative"), F.count(F.lit(1)).alias("class_size"))
    return sets.join(classes, "h").select(key, "representative", F.col("n").alias("n_lines"), "class_size")


def shared_lines(texts: DataFrame, key: str, text: str, least: int = 4, ratio: float = 0.6) -> DataFrame:
    """a, b, shared, ratio: pairs whose non-trivial trimmed lines (8 characters or more, not only brackets) overlap.

    Equal line sets are compared once, through their smallest key (``line_set_members`` tells whose it is); the
    denominator is the smaller set.  Two sets that share enough share a line among the rarest of the smaller one and one
    among all but the ``least`` - 1 commonest of the larger one, so only those meet; what meets is counted on whole sets.
    """
    lines = _lines(texts, key, text)
    sets = lines.groupBy(key).agg(F.sort_array(F.collect_list(F.xxhash64("line"))).alias("h"))
    reps = sets.groupBy("h").agg(F.min(key).alias(key)).select(key, "h", F.size("h").alias("n")).filter(F.col("n") >= least)
    rows = reps.select(key, "n", F.explode("h").alias("line"))
    often = rows.groupBy("line").agg(F.count(F.lit(1)).alias("df"))
    ordered = rows.join(often.filter("df > 1"), "line").groupBy(key, "n").agg(F.sort_array(F.collect_list(F.struct("df", "line"))).alias("own"))  # a line of one set leads to none
    # the lines left out by df are rare ones: the prefix counts them as its first
    alone = F.col("n") - F.size("own")
    need = F.greatest(F.lit(least), F.ceil(F.col("n") * ratio - 1e-9).cast("int"))
    small = ordered.select(F.col(key).alias("a"), F.col("n").alias("na"), F.explode(F.slice("own", F.lit(1), F.greatest(F.col("n") - need + 1 - alone, F.lit(0)))["line"]).alias("line"))
    large = ordered.select(F.col(key).alias("b"), F.col("n").alias("nb"), F.explode(F.slice("own", F.lit(1), F.greatest(F.col("n") - least + 1 - alone, F.lit(0)))["line"]).alias("line"))
    met = small.join(large, "line").filter("na < nb OR na = nb AND a < b").select("a", "b").distinct()
    whole = lambda end: reps.select(F.col(key).alias(end), F.col("h").alias(f"h{end}"))
    both = met.join(whole("a"), "a").join(whole("b"), "b")
    shared = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.size(F.array_intersect("ha", "hb")).cast("bigint").alias("shared"), F.least(F.size("ha"), F.size("hb")).alias("n"))
    share = F.col("shared") / F.col("n")
    return shared.filter((F.col("shared") >= least) & (share >= ratio)).select("a", "b", "shared", F.round(share, 6).alias("ratio"))


def kind_is(kind: str) -> Column:
    """``class`` stands for every kind of type."""
    return F.col("kind").isin("class", "interface", "enum", "type") if kind == "class" else F.col("kind") == kind


def merged_edges(edges: DataFrame, keys: list[str], confidence: str, evidence: str, n: int = 8) -> DataFrame:
    """Edges of one key as one: their count, best confidence and first ``n`` pieces of evidence."""
    first = top_per_key(edges.select(*keys, evidence).distinct(), keys, [F.col(evidence)], n)
    first = first.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(evidence)), " ").alias("evidence"))
    return edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("edge_count"), F.max(confidence).alias("confidence")).join(first, keys)


def reserved_slots(df: DataFrame, key: str, kind: str, order: list[Column], reserved: int, most: int) -> DataFrame:
    """At most ``most`` rows a key at places ``place``: the first ``reserved`` of each kind come before all others."""
    ranked = df.withColumn("_k", F.row_number().over(W.partitionBy(key, kind).orderBy(*order)))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.when(F.col("_k") <= reserved, 0).otherwise(1), *order))
    return ranked.withColumn("place", place).filter(F.col("place") <= most).drop("_k")


def spent_budget(rows: DataFrame, keys: list[str], order: list, size: str, budget: int, least: int = 500, most: int = 5, each: str | int | None = None) -> DataFrame:
    """``rows`` that a key's budget is spent on, one after another in their order, with ``place``, ``taken``, ``truncated`` and ``used`` (so far).

    A row takes its ``size``, at most ``each`` (a number, or a column of the row) and what is left; with less than ``least`` left no more
    are taken, nor after ``most`` rows.  Rows without a size take nothing and no place.  As each row takes something, a key's first
    ``most`` rows decide; only they are gathered.
    """
    some = top_per_key(rows.filter(F.col(size) > 0), keys, order, most)
    own = [c for c in some.columns if c not in (*keys, "rn")]
    at_most = F.col(size) if each is None else F.least(F.col(size), F.lit(each) if isinstance(each, int) else F.col(each))
    listed = some.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rn", at_most.cast("bigint").alias("want"), F.col(size).cast("bigint").alias("whole")))).alias("r"))

    def take(used, row):
        left = F.lit(budget) - used["used"]
        n = F.when(used["open"] & (left >= least), F.least(row["want"], left)).otherwise(0)
        taken = F.struct(row["rn"].alias("rn"), n.alias("taken"), (n < row["whole"]).alias("truncated"), (used["used"] + n).alias("used"))
        return F.struct((used["used"] + n).alias("used"), (used["open"] & (left >= least)).alias("open"), F.concat(used["rows"], F.array(taken)).alias("rows"))

    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(True).alias("open"), F.expr("cast(array() as array<struct<rn: int, taken: bigint, truncated: boolean, used: bigint>>)").alias("rows"))
    spent = listed.select(*keys, F.explode(F.filter(F.aggregate("r", start, take)["rows"], lambda x: x["taken"] > 0)).alias("x")).select(*keys, "x.*")
    return some.select(*keys, "rn", *own).join(spent, [*keys, "rn"]).withColumnRenamed("rn", "place")


def within_budget(df: DataFrame, keys: list[str], order: list[Column], size: str, budget: int, most: int) -> DataFrame:
    """The first rows of a key (``most`` at most) whose sizes so far, ``used``, stay within the budget."""
    w = W.partitionBy(*keys).orderBy(*order)
    first = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most)  # a rank limit cuts groups before the sum
    return first.withColumn("used", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("used") <= budget).drop("_rn")


def priority_union(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Each key once with the first of ``parts`` (in order) that has it, its ``origin``."""
    every = None
    for k, (name, df) in enumerate(parts.items()):
        part = df.select(*keys, F.struct(F.lit(k).alias("p"), F.lit(name).alias("origin")).alias("o"))
        every = part if every is None else every.union(part)
    return every.groupBy(*keys).agg(F.min("o").alias("o")).select(*keys, "o.origin")


def side_by_side(parts: list[DataFrame]) -> DataFrame:
    """Tables of one row each as one row."""
    one = F.lit(1).alias("_one")
    out = parts[0].select("*", one)
    for p in parts[1:]:
        out = out.join(p.select("*", one), "_one")
    return out.drop("_one")


def groups_with_rows(rows: DataFrame, key: Column, kind: str, row: str, order: list[Column], n: int = 10) -> DataFrame:
    """key, n, kinds, first_rows: each group's size, distinct kinds and its first ``n`` rows in order."""
    rows = rows.withColumn("key", key)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("kinds"))
    first = top_per_key(rows, ["key"], order, n).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rn", F.col(row).alias("x")))).alias("r"))
    return sizes.join(first.select("key", F.array_join(F.transform("r", lambda x: x["x"]), " ").alias("first_rows")), "key")


def log_totals(log: DataFrame) -> DataFrame:
    """One row over a log (duration_ms, stale, degraded, debug_timed, reason): counts, fallbacks, average, largest, 95th percentile."""
    return log.agg(
        F.count(F.lit(1)).alias("events"), *(F.count_if(c).alias(c) for c in ("stale", "degraded", "debug_timed")), F.count_if(F.col("degraded") | F.col("reason")).alias("fallback"),
        F.floor(F.sum("duration_ms") / F.count(F.lit(1)) + 0.5).alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").alias("p95_ms"),
    )


def log_score() -> Column:
    """A log's score of 100 and less, from its counts of invalid lines, stale, degraded and fallback answers and its slowest one."""
    slow = F.when(F.col("max_ms") >= 5000, F.least(F.lit(12), F.floor((F.col("max_ms") - 5000) / 500))).otherwise(0)
    lost = F.least("invalid", F.lit(25)) + F.least(F.col("stale") * 4, F.lit(20)) + F.least(F.col("degraded") * 3, F.lit(18)) + F.least(F.floor(F.col("fallback") / 2) * 2, F.lit(10)) + slow
    return F.greatest(100 - lost, F.lit(0)).cast("bigint")


#: The least score of each grade.
GRADES = ((96, "A+"), (92, "A"), (84, "B+"), (76, "B"), (64, "C"), (50, "D"))


def grade(score: str) -> Column:
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(F.col(score) >= least, name).otherwise(out)
    return out
