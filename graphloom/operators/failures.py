"""Build failures, stack traces, Java diffs and contracts, as expressions over exploded lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import left_out, top_per_key

#: The line formats of compilers and stack traces as (pattern, file, line, message groups; 0: none).
FORMATS = (
    (r"^(\S+?)\((\d+),\d+\): error (.*)$", 1, 2, 3),
    (r"^\[ERROR\]\s+(\S+?):\[(\d+),\d+\]\s*(.*)$", 1, 2, 3),
    (r"^\s+at [\w.$<>]+\(([\w$]+\.java):(\d+)\)", 1, 2, 0),
    (r"^(\S+?\.\w+):(\d+)(?::\d+)?:?\s+(.*)$", 1, 2, 3),
)
FRAMEWORK = r"^\s+at (?:java|javax|jdk|sun|jakarta|org\.springframework|org\.apache|org\.junit|org\.hibernate)\."
CONTRACTS = (("api", r"openapi|swagger|controller|/api/"), ("schema", r"\.(sql|xsd|proto|avsc)$|schema|migration"), ("messaging", r"kafka|queue|topic|event|listener"), ("security", r"security|auth|permission"), ("test", r"test|spec"), ("docs", r"\.(md|adoc|rst)$"))


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, k (from 0), line"""
    return df.select(key, F.posexplode(F.split(text, "\r?\n")).alias("k", "line"))


def errors(logs: DataFrame, key: str = "id", text: str = "text", most: int = 40) -> DataFrame:
    """key, file, line, message, from_line, to_line, left_out: the first ``most`` places that a log names, each once, with the 90
    lines around; ``left_out`` counts the others."""
    rows = lines_of(logs, key, text)

    def part(group: int) -> Column:
        return F.coalesce(*(F.when(F.col("line").rlike(p), F.regexp_extract("line", p, groups[group]) if groups[group] else F.lit("")) for p, *groups in FORMATS))

    found = rows.select(key, "k", part(0).alias("file"), part(1).cast("int").alias("line"), part(2).alias("message")).filter("file IS NOT NULL")
    once = found.groupBy(key, "file", "line").agg(F.min("k").alias("k"), F.min_by("message", "k").alias("message"))
    n = once.groupBy(key).agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("left_out"))
    first = top_per_key(once, [key], [F.col("k")], most).join(n, key)
    return first.select(key, "file", "line", "message", F.greatest(F.col("line") - 25, F.lit(1)).alias("from_line"), (F.greatest(F.col("line") - 25, F.lit(1)) + 89).alias("to_line"), "left_out")


def compressed_trace(logs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, k, line: a trace with runs of framework frames as counts and repeated lines once."""
    w = W.partitionBy(key).orderBy("k")
    rows = lines_of(logs, key, text).withColumn("framework", F.col("line").rlike(FRAMEWORK))
    rows = rows.withColumn("again", F.coalesce(F.col("line") == F.lag("line").over(w), F.lit(False))).filter("NOT again OR framework")
    rows = rows.withColumn("run", F.sum(F.when(F.col("framework") & F.coalesce(F.lag("framework").over(w), F.lit(False)), 0).otherwise(1)).over(w))
    out = rows.groupBy(key, "run").agg(F.min("k").alias("k"), F.first("framework").alias("f"), F.min("line").alias("line"), F.count("*").alias("n"))
    return out.select(key, "k", F.when(F.col("f"), F.concat(F.lit("\t... "), "n", F.lit(" framework frames"))).otherwise(F.col("line")).alias("line"))


def diff_categories(diffs: DataFrame, key: str = "id", text: str = "diff") -> DataFrame:
    """key, file, added, removed, annotations, signatures, imports, sql: changed lines of each file of a diff by category."""
    w = W.partitionBy(key).orderBy("k")
    rows = lines_of(diffs, key, text).withColumn("file", F.last(F.when(F.col("line").startswith("+++ "), F.regexp_extract("line", r"^\+\+\+ (?:b/)?(\S+)", 1)), ignorenulls=True).over(w))
    rows = rows.filter(F.col("line").rlike(r"^[-+](?!\+\+ |-- )") & F.col("file").isNotNull())
    has = lambda p: F.count_if(F.col("line").rlike(p))
    return rows.groupBy(key, "file").agg(
        has(r"^\+").alias("added"), has("^-").alias("removed"), has(r"^.\s*@\w+").alias("annotations"), has(r"^.\s*(?:public|protected|private)\s[^=;]*\(").alias("signatures"),
        has(r"^.\s*import\s").alias("imports"), has(r"(?i)\b(?:select|insert|update|delete)\b.+\b(?:from|into|set)\b").alias("sql"),
    )


def contracts(files: DataFrame, changed: DataFrame) -> DataFrame:
    """path, type: files of a contract's types in a folder that ``changed`` (path) touches."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    near = files.select("path", folder.alias("folder")).join(changed.select(folder.alias("folder")).distinct(), "folder", "left_semi")
    types = F.array_compact(F.array(*(F.when(F.lower("path").rlike(p), F.lit(t)) for t, p in CONTRACTS)))
    return near.select("path", F.explode(types).alias("type"))


def missing_contracts(files: DataFrame, changed: DataFrame) -> DataFrame:
    """type: the contract types that no file near a change has."""
    every = files.sparkSession.createDataFrame([(t,) for t, _ in CONTRACTS], "type string")
    return every.join(contracts(files, changed), "type", "left_anti")


def graph_json(edges: DataFrame) -> DataFrame:
    """value: one JSON line a node and an edge of (source, target, type, edge_count), ready for a text sink."""
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().select(F.to_json(F.struct(F.lit("node").alias("record"), "id")).alias("value"))
    return nodes.union(edges.select(F.to_json(F.struct(F.lit("edge").alias("record"), "source", "target", "type", "edge_count"))))


#: Lines of a build that say nothing, and those that are kept; lines of an error, and its frames.
NOISE = r"(?i)^\s*(Downloading from |Downloaded from |Uploading to |Uploaded to |Progress \(|Transferring |> Task :[^ ]+\s+(UP-TO-DATE|SKIPPED|NO-SOURCE)\s*$)"
KEPT = (
    r"(?i)\bBUILD (FAILURE|FAILED|SUCCESS)\b|\bTests run:\s*\d+|\bFailures:\s*[1-9]|\bErrors:\s*[1-9]|\bFailed tests?:|\bCompilation failure\b|\bThere are test failures\b",
    r"\b(Exception|Error|AssertionError)\b|\bCaused by:|^\[ERROR\]|^\[WARNING\]|^\s*at\s+[\w.$]+\(.*:\d+\)", r"(?i)^>\s*Task .* FAILED\b",
)
TELLING = r"(?i)(error|exception|failed|failure|panic|fatal|assertion|caused by|expected|received|actual)"
FRAMES = r"^\s*at\s+|^\s*File \".+\", line \d+|^\s*#\d+\s+"


def _once(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.rtrim("line").alias("line"), "k").groupBy(key, "line").agg(F.min("k").alias("k"))


def _digest(sections: dict[str, tuple[DataFrame, int | None]], key: str) -> DataFrame:
    """Of each log the first distinct lines (of ``last`` the last ones) of each section, in their order."""
    out = None
    for name, (rows, most) in sections.items():
        part = top_per_key(_once(rows, key), [key], [F.desc("k") if name == "last" else F.col("k")], most).select(key, F.lit(name).alias("section"), "k", "line")
        out = part if out is None else out.union(part)
    return out


def _left_out(sections: dict[str, tuple[DataFrame, int | None]], key: str) -> DataFrame:
    out = None
    for name, (rows, most) in sections.items():
        part = left_out(_once(rows, key), [key], most).select(key, F.lit(name).alias("section"), "n", "left_out")
        out = part if out is None else out.union(part)
    return out


def _build_sections(logs: DataFrame, key: str, text: str, most: int | None) -> dict[str, tuple[DataFrame, int | None]]:
    rows = lines_of(logs, key, text).filter(~F.col("line").rlike(NOISE))
    keep = F.col("line").rlike(KEPT[0]) | F.col("line").rlike(KEPT[1]) | F.col("line").rlike(KEPT[2])
    said = rows.filter(F.trim("line") != "")
    return {"kept": (rows.filter(keep), most), "first": (said, 12), "last": (said, 20)}


def build_digest(logs: DataFrame, key: str = "id", text: str = "text", most: int | None = 180) -> DataFrame:
    """key, section, k, line of a build's log: telling lines (``most`` of them, None: all), the first 12 and the last 20 that are no noise; each
    line once a section.  ``build_left_out`` counts the others."""
    return _digest(_build_sections(logs, key, text, most), key)


def build_left_out(logs: DataFrame, key: str = "id", text: str = "text", most: int | None = 180) -> DataFrame:
    """key, section, n, left_out: distinct lines of each section, and those that the digest has no room for."""
    return _left_out(_build_sections(logs, key, text, most), key)


def _error_sections(logs: DataFrame, key: str, text: str, most: int | None, frames: int | None) -> dict[str, tuple[DataFrame, int | None]]:
    rows = lines_of(logs, key, text)
    return {"summary": (rows.filter(F.col("line").rlike(TELLING)), most), "frames": (rows.filter(F.col("line").rlike(FRAMES)), frames), "last": (rows, 20)}


def error_digest(logs: DataFrame, key: str = "id", text: str = "text", most: int | None = 120, frames: int | None = 24) -> DataFrame:
    """key, section, k, line of an error's text: telling lines (``most``), ``frames`` (None: all) and the last 20 lines; each line once a
    section.  ``error_left_out`` counts the others."""
    return _digest(_error_sections(logs, key, text, most, frames), key)


def error_left_out(logs: DataFrame, key: str = "id", text: str = "text", most: int | None = 120, frames: int | None = 24) -> DataFrame:
    """key, section, n, left_out: distinct lines of each section, and those that the digest has no room for."""
    return _left_out(_error_sections(logs, key, text, most, frames), key)


def log_kind(text: str | Column) -> Column:
    """What a tool's output is: java-trace, build-log, error-summary, json-result or plain, the first that fits."""
    t = F.col(text) if isinstance(text, str) else text
    frames = F.size(F.regexp_extract_all(t, F.lit(r"(?m)^\s*at\s+[\w.$]+\(.*:\d+\)"), F.lit(0))) >= 3
    trace = t.rlike(r"(?:^|\n)(?:Exception in thread|Caused by:|[\w.$]+(?:Exception|Error):)") & frames
    build = t.rlike(r"\b(mvn|Maven|Gradle|gradlew|BUILD FAILURE|BUILD FAILED|Tests run:)") & t.rlike(r"(?i)\b(Downloading from|Transferring|BUILD FAILURE|BUILD FAILED|Tests run:)")
    wrong = t.rlike(r"(?i)(error|exception|failed|failure|panic|fatal|assertion)") & (F.length(t) > 800)
    body = F.trim(t)
    shaped = (F.length(body) > 200) & ((body.startswith("{") & body.endswith("}")) | (body.startswith("[") & body.endswith("]")))
    return F.when(trace, "java-trace").when(build, "build-log").when(shaped, "json-result").when(wrong, "error-summary").otherwise("plain")
