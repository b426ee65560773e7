"""Snapshots: tables by snapshot, the pointer to the current one, incremental refresh, freshness, shards and exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import versions

#: Most changed files of an incremental refresh, and their share of all.
MOST_CHANGED, CHANGED_SHARE = 500, 0.2


def write_facts(tables: dict[str, DataFrame], base: str, snapshot: str) -> None:
    """Each table of a snapshot below ``base``/table/snapshot_id=...; a repeated write replaces what was there."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/{name}/snapshot_id={snapshot}")


def commit(spark: SparkSession, base: str, snapshot: str, expected: int | None = None) -> int:
    """Make a written snapshot the current one; gives the new version of the pointer.

    With ``expected`` it fails with ``versions.Conflict`` unless that is the pointer's version; without, it follows whatever is there.
    The pointer is a log of versions: readers see the old one or the new one, always one of them.
    """
    log = f"{base}/_current"
    return versions.update(spark, log, lambda _: {"snapshot": snapshot}) if expected is None else versions.append(spark, log, {"snapshot": snapshot}, expected)


def current(spark: SparkSession, base: str) -> str | None:
    """The current snapshot's id; None before the first commit."""
    _, body = versions.read_version(spark, f"{base}/_current")
    return body and body["snapshot"]


def read_facts(spark: SparkSession, base: str, name: str, snapshot: str | None = None) -> DataFrame:
    """A table of a snapshot, the current one by default."""
    return spark.read.parquet(f"{base}/{name}/snapshot_id={snapshot or current(spark, base)}")


def copy_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    r"""Tab-separated shards: ``\N`` is null, ``\t``, ``\n`` and ``\\`` are escaped."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("v"))
    fields = [x.strip().split(" ", 1) for x in schema.split(",")]
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("\\\\"), F.lit("\0")), F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))
    return lines.select(*(F.when(F.col("v")[k] != "\\N", plain(F.col("v")[k])).cast(kind).alias(name) for k, (name, kind) in enumerate(fields)))


def fact_shards(parsed: DataFrame, arrays: tuple[str, ...], key: str = "path") -> dict[str, DataFrame]:
    """A table for each nested array of parse results: its structs as rows, with the file's key."""
    return {a: parsed.select(key, F.explode(a).alias("x")).select(key, "x.*") for a in arrays}


def merged_providers(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Facts of several providers, each key once: the first provider's row (in order), with ``provider``."""
    every = None
    for k, (name, df) in enumerate(parts.items()):
        part = df.select("*", F.lit(name).alias("provider"), F.lit(k).alias("_p"))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in keys and c != "_p"]
    best = every.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_p").alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in rest))


def scoped(manifest: DataFrame, previous: DataFrame, paths: DataFrame) -> DataFrame:
    """path, status of explicit changed paths: present (found now), deleted (only in the previous manifest) or unknown."""
    now, old = manifest.select("path", F.lit(1).alias("n")), previous.select("path", F.lit(1).alias("o"))
    rows = paths.select("path").distinct().join(now, "path", "left").join(old, "path", "left")
    return rows.select("path", F.when(F.col("n").isNotNull(), "present").when(F.col("o").isNotNull(), "deleted").otherwise("unknown").alias("status"))


def refreshed(facts: DataFrame, fresh: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """Facts after a refresh: those of changed and deleted files go, the fresh ones come."""
    return facts.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh)


def affected_sources(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """path: files whose edges must be derived again: the changed ones and those with an edge into them."""
    into = edges.join(changed.select(F.col("path").alias("b")), "b", "left_semi").select(F.col("a").alias("path"))
    return changed.select("path").union(into).distinct()


def refresh_decision(changes: DataFrame, n_files: Column | int) -> DataFrame:
    """changed, limit, incremental: whether the changes (change: added, modified, deleted) are few enough to refresh."""
    n = changes.filter("change <> 'unchanged'").agg(F.count(F.lit(1)).alias("changed"))
    files = F.lit(n_files) if isinstance(n_files, int) else n_files
    limit = F.greatest(F.lit(1), F.least(F.lit(MOST_CHANGED), F.ceil(files * CHANGED_SHARE)))
    return n.select("changed", limit.cast("bigint").alias("limit"), ((F.col("changed") > 0) & (F.col("changed") <= limit)).alias("incremental"))


def freshness(changes: DataFrame, samples: int = 20) -> DataFrame:
    """One row: files by change, whether the snapshot is stale, and the first changed paths."""
    rows = changes.agg(
        *(F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted", "unchanged")),
        F.array_join(F.slice(F.sort_array(F.collect_list(F.when(F.col("change") != "unchanged", F.col("path")))), 1, samples), " ").alias("samples"),
    )
    return rows.select((F.col("added") + F.col("modified") + F.col("deleted") > 0).alias("stale"), "*")


def coalesced(requests: DataFrame, key: str, begin: str, end: str, order: str) -> DataFrame:
    """Requests with ``run``: one that begins while another of its key still runs joins it."""
    w = W.partitionBy(key).orderBy(begin, order)
    until = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(until.isNull() | (F.col(begin) > until), 1).otherwise(0)
    return requests.withColumn("_o", opens).withColumn("run", F.sum("_o").over(w)).drop("_o")


def append_events(events: DataFrame, path: str) -> None:
    """Telemetry as JSON lines, appended."""
    events.write.mode("append").json(path)


def markdown_table(rows: DataFrame, order: list[Column]) -> DataFrame:
    """place, line: a table as Markdown, for results of a page; places are 1 (head), 2 (rule), 3 and on."""
    w = W.orderBy(*order)  # a page, not a table
    cells = lambda cols: F.concat(F.lit("| "), F.concat_ws(" | ", *cols), F.lit(" |"))
    body = rows.select((F.row_number().over(w) + 2).alias("place"), cells([F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in rows.columns]).alias("line"))
    head = rows.sparkSession.createDataFrame([(1, "| " + " | ".join(rows.columns) + " |"), (2, "|" + "---|" * len(rows.columns))], "place int, line string")
    return head.union(body)


def sarif(findings: DataFrame, tool: str) -> DataFrame:
    """value: a SARIF 2.1.0 log in one row, from findings (rule, priority, file, line, message), ordered."""
    level = F.when(F.col("priority") == "P0", "error").when(F.col("priority") == "P1", "warning").otherwise("note")
    result = F.struct(
        F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    ranked = findings.select(F.struct("priority", "file", "rule", "line", result.alias("r")).alias("x"))
    all_ = ranked.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["r"]).alias("results"))  # findings of one review
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name")).alias("driver")).alias("tool"), F.col("results"))
    return all_.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("value"))


def test_list(tests: DataFrame, form: str) -> DataFrame:
    """value: selected tests (path) for a runner: ``list`` (a path a row), ``json``, ``maven`` or ``gradle`` (one row)."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]+$", "")
    if form == "list":
        return tests.select(F.col("path").alias("value"))
    if form == "json":
        return tests.agg(F.to_json(F.sort_array(F.collect_list("path"))).alias("value"))
    names = F.sort_array(F.collect_set(name))
    return tests.agg(F.concat(F.lit("-Dtest="), F.array_join(names, ",")).alias("value") if form == "maven" else F.array_join(F.transform(names, lambda n: F.concat(F.lit("--tests "), n)), " ").alias("value"))


_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title><style>body{{font:14px sans-serif;margin:2em}}td,th{{padding:2px 8px;text-align:left}}input{{margin-bottom:1em}}</style>
<h1>{title}</h1><input id="q" placeholder="filter"><table id="t"><thead><tr><th>from</th><th>type</th><th>to</th><th>edges</th></tr></thead><tbody></tbody></table>
<script>const rows={rows};const body=document.querySelector("tbody"),q=document.getElementById("q");
function show(){{const f=q.value.toLowerCase();body.replaceChildren(...rows.filter(r=>r.join(" ").toLowerCase().includes(f)).map(r=>{{const tr=document.createElement("tr");for(const c of r){{const td=document.createElement("td");td.textContent=c;tr.append(td)}}return tr}}))}}q.oninput=show;show();</script>"""


def graph_page(edges: DataFrame, title: str, most: int = 2000) -> str:
    """A page with the ``most`` heaviest edges (source, type, target, edge_count) as a table that filters as one types."""
    rows = [[r.source, r.type, r.target, r.edge_count] for r in edges.orderBy(F.desc("edge_count"), "source", "target", "type").limit(most).collect()]
    return _PAGE.format(title=title, rows=json.dumps(rows).replace("</", "<\\/"))


def cached_parses(files: DataFrame, cache: DataFrame, provider: str, version: str) -> DataFrame:
    """Files (path, blob_hash, ...) with ``hit``: whether the cache (provider, version, blob_hash) has their parse; equal contents
    are parsed once, whatever their paths."""
    known = cache.filter((F.col("provider") == provider) & (F.col("version") == version)).select("blob_hash", F.lit(True).alias("hit")).distinct()
    return files.join(known, "blob_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def to_parse(files: DataFrame, cache: DataFrame, provider: str, version: str) -> DataFrame:
    """One file of each content that the cache lacks: the first path stands for it."""
    rest = cached_parses(files, cache, provider, version).filter("NOT hit")
    return rest.groupBy("blob_hash").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n_files"))
