"""Source trees: file manifests, roles and languages, and fact extraction."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages by extension, folders that are not scanned, and built files that are no sources.
LANGUAGES = {
    ".java": "java", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".cs": "csharp", ".php": "php",
    ".xml": "xml", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".properties": "properties",
}
SKIPPED = (
    ".git", ".graphloom", "benchmark-results", ".tmp", ".idea", ".vscode", "node_modules", "target", "build", "dist", "coverage", ".next", ".turbo", ".cache", "bin", "obj", ".gradle", "__pycache__", "vendor", "third_party", "third-party",
)
MINIFIED = r"(?i)(\.min\.(js|mjs|cjs|css)|\.bundle\.(js|mjs)|-min\.js)(\.map)?$"
PARSEABLE = ("java", "javascript", "python", "typescript")


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))
    out = None
    for e, lang in LANGUAGES.items():
        out = F.when(ext == e, lang) if out is None else out.when(ext == e, lang)
    return out


#: How a path tells a file's role, in order of precedence.
VENDORED = r"/(vendor|node_modules|third_party|\.m2|target|build|dist)/"
GENERATED = r"(^|/)([^/]*[-_.])?generated([-_.][^/]*)?(/|$)|\.g\.java$"
BUILD_FILES = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradle.properties")
RESOURCES = r"\.(xml|yaml|yml|properties|json)$"
MOCKS = r"(^|/)(__mocks__|mock|mocks|fixtures|testdata|stub|stubs)(/|$)"
TESTS = (
    r"(^|/)(__tests__|__test__|test|tests|spec|specs)(/|$)|(^|/)(e2e|e2e_test|e2e_tests|e2e-test|e2e-tests|e2etest|e2etests)(/|$)|(^|/)(step_definitions|step-definitions|pageobjects|page_objects|page-objects)(/|$)"
    r"|(^|/)(cypress|playwright|integration_test|integration-tests?)(/|$)|test[-_]fixtures?(/|$)|\.(test|spec)\.[cm]?[jt]sx?$|tests?\.java$|spec\.ts$|test\.ts$"
)


def role_of(path: Column) -> Column:
    """vendored, generated, build_config, resource_config (also what has no language), mock, test or main, first match first."""
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    return (
        F.when(p.rlike(VENDORED), "vendored").when(p.rlike(GENERATED), "generated").when(F.substring_index(p, "/", -1).isin(*BUILD_FILES), "build_config")
        .when(p.rlike(RESOURCES) | language_of(path).isNull(), "resource_config").when(p.rlike(MOCKS), "mock_source").when(p.rlike(TESTS), "test_source").otherwise("main_source")
    )


def _found(spark: SparkSession, root: str, max_bytes: int | None) -> DataFrame:
    """path, size, mtime, content of all files below a folder, and why one is not read (null for others)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    skip = "(^|/)(" + "|".join(map(re.escape, SKIPPED)) + ")/"
    why = F.when(F.col("path").rlike(skip), "folder").when(F.col("path").rlike(MINIFIED), "minified").when(F.lit(max_bytes is not None) & (F.col("size") > F.lit(max_bytes or 0)), "too large")
    return found.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content").withColumn("why", why)


def not_read(spark: SparkSession, root: str, max_bytes: int | None = 5 << 20) -> DataFrame:
    """path, size, why: files below a folder that ``manifest`` leaves out: too large, minified or in a skipped folder."""
    return _found(spark, root, max_bytes).filter("why is not null").select("path", "size", "why")


def manifest(spark: SparkSession, root: str, max_bytes: int | None = 5 << 20) -> DataFrame:
    """path, size, mtime, blob_hash, language, role, content of the files below a folder of at most ``max_bytes`` (None: any size);
    ``not_read`` names the others."""
    out = _found(spark, root, max_bytes).filter("why is null")
    return out.select("path", "size", "mtime", F.sha2("content", 256).alias("blob_hash"), language_of(F.col("path")).alias("language"), role_of(F.col("path")).alias("role"), "content")


def reuse_hashes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Hashes of the previous manifest where size and time are the same."""
    old = before.select("path", "size", "mtime", F.col("blob_hash").alias("old_hash"))
    return now.join(old, ["path", "size", "mtime"], "left").withColumn("blob_hash", F.coalesce("old_hash", "blob_hash")).drop("old_hash")


FACTS = "path string, fact string, name string, owner string, line long, end_line long, confidence double"
#: What a line declares where there is no tree.
_LINE_RULES = (
    ("import", re.compile(r"^\s*import\b.*?['\"]([^'\"]+)['\"]")), ("import", re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;")),
    ("class", re.compile(r"\b(?:class|interface|enum)\s+(\w+)")), ("function", re.compile(r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)")),
    ("variable", re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)")), ("method", re.compile(r"^\s+(?:public |private |protected |static |async |final )*[\w<>\[\], ]*?(\w+)\s*\([^;{}]*\)\s*(?::[^{]+)?\{")),
)


def python_facts(path: str, text: str) -> list[tuple]:
    """Symbols, imports and calls of a Python file by its syntax tree, in the order of a walk with a stack of its own."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [(path, "parse_error", None, None, 1, None, 0.0)]
    out: list[tuple] = []
    todo: list[tuple[ast.AST, bool, str | None]] = [(tree, False, None)]  # node, inside a class, owner
    while todo:
        node, in_class, owner = todo.pop()
        inner, opens = owner, False
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            opens = isinstance(node, ast.ClassDef)
            out.append((path, "class" if opens else "method" if in_class else "function", node.name, owner, node.lineno, node.end_lineno, 1.0))
            inner = f"{owner}.{node.name}" if owner else node.name
        elif isinstance(node, ast.Import):
            out.extend((path, "import", a.name, owner, node.lineno, node.end_lineno, 1.0) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            out.append((path, "import", "." * node.level + (node.module or ""), owner, node.lineno, node.end_lineno, 1.0))
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                out.append((path, "call", name, owner, node.lineno, node.end_lineno, 0.8))
        todo.extend((child, opens, inner) for child in reversed(list(ast.iter_child_nodes(node))))
    return out


def line_facts(path: str, text: str, confidence: float = 0.35) -> list[tuple]:
    """Symbols and imports of a brace language, line by line."""
    out = []
    for k, line in enumerate(text.split("\n"), 1):
        for fact, rule in _LINE_RULES:
            m = rule.search(line)
            if m and m[1] not in ("if", "for", "while", "switch", "catch", "return"):
                out.append((path, fact, m[1], None, k, k, confidence))
                break
    return out


_OFF = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_TYPE = re.compile(r"\b(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)")
_SUPER = re.compile(r"\b(extends|implements)\s+([\w$.<>\[\], ]+?)(?=\b(?:extends|implements|permits)\b|$)")
_ROUTINE = re.compile(r"([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\s*\((?:[^()]|\([^()]*\))*\)\s*(?:throws\s[\w$., ]+|:\s*[^={}]+)?$")
_ARROW = re.compile(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\((?:[^()]|\([^()]*\))*\)|[\w$]+)\s*(?::[^={}]+)?=>\s*$")
_CALL = re.compile(r"(\bnew\s+)?((?:[A-Za-z_$][\w$]*\s*\.\s*)*[A-Za-z_$][\w$]*)\s*(?:<[\w$, ?]*>)?\s*\(")
_JAVA_FIELD = re.compile(r"^(?:@[\w.]+\s*(?:\([^()]*\))?\s*)*(?:(?:public|private|protected|static|final|volatile|transient)\s+)*([A-Z][\w$.]*(?:<[^;=]*>)?(?:\[\])*|int|long|double|float|boolean|char|byte|short)\s+([A-Za-z_$][\w$]*)\s*(?:=.*)?$", re.S)
_SCRIPT_FIELD = re.compile(r"^(?:@[\w.]+\s*(?:\([^()]*\))?\s*)*(?:(?:public|private|protected|static|readonly|declare)\s+)*([A-Za-z_$#][\w$]*)\s*[?!]?\s*:\s*([\w$.<>\[\], |]+?)\s*(?:=.*)?$", re.S)
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "synchronized", "super", "this", "function", "throw", "new", "await", "typeof", "else", "do", "try", "constructor", "assert"}


def brace_facts(path: str, text: str, language: str, confidence: float = 0.7) -> list[tuple]:
    """Types, members, fields, calls, imports and supertypes of a Java, JavaScript or TypeScript file, with owners and last lines.

    Comments and strings are blanked, then braces, semicolons and brackets are walked once with a stack of scopes: what
    stands before a brace tells what it opens.  A file whose braces do not match is read line by line instead.
    """
    clean = _OFF.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    breaks = [m.start() for m in re.finditer("\n", clean)]
    line = lambda at: bisect_left(breaks, at) + 1
    out: list[tuple] = [(path, "import", m[1] or m[2], None, line(m.start()), line(m.start()), confidence) for m in re.finditer(r"(?m)^\s*import\b(?:\s+(?:static\s+)?([\w.*]+)\s*;|[^'\"\n;]*['\"]([^'\"\n]+)['\"])", text)]
    scopes: list[tuple[str, str, int, int]] = []  # kind, name, first line, open brackets around
    begin = brackets = 0

    def names(kinds: tuple[str, ...]) -> str | None:
        return ".".join(n for k, n, *_ in scopes if k in kinds and n) or None

    def calls(part: str, at: int) -> None:
        if any(k in ("method", "function") for k, *_ in scopes):
            caller = names(("class", "interface", "enum", "record", "method", "function"))
            for m in _CALL.finditer(part):
                name = re.sub(r"\s+", "", m[2])
                if name not in _NO_CALL:
                    out.append((path, "call", f"{name}.new" if m[1] else name, caller, line(at + m.start(2)), line(at + m.start(2)), confidence))

    def opened(head: str) -> tuple[str, str]:
        if found := _TYPE.search(head):
            return found[1], found[2]
        inside = scopes[-1][0] if scopes else ""
        if found := _ARROW.search(head):
            return "function", found[1]
        found = _ROUTINE.search(head)
        if found and found[1] not in _NO_CALL - {"constructor"}:
            if inside in ("class", "interface", "enum", "record") and not re.search(r"\bnew\s+[\w$.<>]+\s*\([^()]*\)$|=", head):
                return "method", found[1]
            if re.search(r"\bfunction\b", head):
                return "function", found[1]
        return "block", ""

    for m in re.finditer(r"[{};()]", clean):
        c, at = m[0], m.start()
        if c in "()":
            brackets = max(brackets + (1 if c == "(" else -1), 0)
            continue
        if c == ";" and brackets:
            continue
        part = clean[begin:at]
        head = part.strip()
        first = line(begin + len(part) - len(part.lstrip()))
        if c == "{":
            kind, name = opened(head[-2000:]) if not brackets else ("block", "")  # a header, not a file without braces
            if kind == "block":
                calls(part, begin)
            elif kind in ("class", "interface", "enum", "record"):
                for s in _SUPER.finditer(head):
                    depth_free = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", s[2]))
                    out.extend((path, s[1], x.strip(), ".".join(filter(None, [names(("class", "interface", "enum", "record")), name])), first, first, confidence) for x in depth_free.split(",") if x.strip())
            scopes.append((kind, name, first, brackets))
            brackets = 0
        else:
            top = scopes[-1][0] if scopes else ""
            field = (_JAVA_FIELD if language == "java" else _SCRIPT_FIELD).match(head) if c == ";" and top in ("class", "record", "enum") else None
            if field:
                name = field[2] if language == "java" else field[1]
                out.append((path, "field", name, names(("class", "interface", "enum", "record")), first, line(at), confidence))
            calls(part, begin)
            if c == "}":
                if not scopes:
                    return line_facts(path, text)
                kind, name, start, brackets = scopes.pop()
                if kind != "block":
                    out.append((path, kind if kind != "record" else "class", name, names(("class", "interface", "enum", "record", "method", "function")), start, line(at), confidence))
        begin = at + 1
    return line_facts(path, text) if scopes else out


def extract(files: DataFrame) -> DataFrame:
    """Facts of files (path, language, content): one row a symbol, import or call."""
    names = [x.split()[0] for x in FACTS.split(", ")]
    schema = pa.schema([(n, pa.int64() if "line" in n else pa.float64() if n == "confidence" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, lang, content in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content"))):
                text = (content or b"").decode("utf-8", "replace")
                rows += python_facts(path, text) if lang == "python" else brace_facts(path, text, lang)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    return files.filter(F.col("language").isin(*PARSEABLE)).select("path", "language", "content").mapInArrow(run, FACTS)


def config_facts(files: DataFrame, most: int = 300) -> DataFrame:
    """path, name, value, left_out of properties and YAML-like ``key: value`` lines, the first ``most`` of a file; ``left_out``
    counts the others."""
    lines = files.filter(F.col("language").isin("properties", "yaml")).select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("k", "l"))
    pair = lines.select("path", "k", F.trim(F.regexp_extract("l", r"^\s*([\w.\-]+)\s*[=:]\s*(.*)$", 1)).alias("name"), F.trim(F.regexp_extract("l", r"^\s*([\w.\-]+)\s*[=:]\s*(.*)$", 2)).alias("value")).filter("name <> ''")
    from ..operators.relational import top_per_key

    first = top_per_key(pair, ["path"], [F.col("k")], most)
    n = pair.groupBy("path").agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("left_out"))
    return first.join(n, "path").select("path", "name", "value", "left_out")


def diff_hunks(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """file, hunk, old_start, new_start, added, removed, context of unified diffs, a row a hunk."""
    from pyspark.sql import Window as W

    lines = diffs.withColumn("d", F.monotonically_increasing_id()).select("d", F.posexplode(F.split(text, "\n")).alias("k", "l"))
    w = W.partitionBy("d").orderBy("k")
    lines = lines.withColumn("file", F.last(F.when(F.col("l").startswith("+++ "), F.regexp_extract("l", r"^\+\+\+ (?:b/)?(\S+)", 1)), ignorenulls=True).over(w))
    lines = lines.withColumn("hunk", F.sum(F.when(F.col("l").startswith("@@ "), 1).otherwise(0)).over(w))
    head = r"^@@ -(\d+)(?:,\d+)? \+(\d+)"
    body = lines.filter("hunk > 0").groupBy("d", "hunk").agg(
        F.max_by("file", -F.col("k")).alias("file"), F.max(F.regexp_extract("l", head, 1)).cast("int").alias("old_start"), F.max(F.regexp_extract("l", head, 2)).cast("int").alias("new_start"),
        F.count_if(F.col("l").startswith("+") & ~F.col("l").startswith("+++ ")).alias("added"), F.count_if(F.col("l").startswith("-") & ~F.col("l").startswith("--- ")).alias("removed"), F.count_if(F.col("l").startswith(" ")).alias("context"),
    )
    return body.drop("d")


def diff_blocks(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """file, added, removed, block: a row for each file's block of a unified diff (what follows a ``diff --git`` line)."""
    parts = F.filter(F.split(text, r"(?:^|\n)diff --git "), lambda x: x != "")
    rows = diffs.select(F.explode(parts).alias("block"))
    lines = F.split("block", "\n")
    n = lambda sign, head: F.size(F.filter(lines, lambda l: l.startswith(sign) & ~l.startswith(head)))
    return rows.select(F.regexp_extract("block", r"\n\+\+\+ (?:b/)?(\S+)", 1).alias("file"), n("+", "+++ ").alias("added"), n("-", "--- ").alias("removed"), "block")


def json_log(spark: SparkSession, path: str) -> DataFrame:
    """ts, tool, session, duration_ms, bad: JSON lines; blank lines are skipped, broken ones marked."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    ok = F.from_json("value", "ts string, event string, toolName string, durationMs double, args struct<sessionId: string>")
    bad = F.expr("try_parse_json(value) IS NULL")
    return lines.select(ok.alias("x"), bad.alias("bad")).select(F.col("x.ts").try_cast("timestamp").alias("ts") if hasattr(F.col("x"), "try_cast") else F.to_timestamp("x.ts").alias("ts"), F.col("x.event").alias("event"), F.col("x.toolName").alias("tool"), F.col("x.args.sessionId").alias("session"), F.col("x.durationMs").alias("duration_ms"), "bad")


def log_window(log: DataFrame, since: str | None = None, until: str | None = None, tool: str | None = None, event: str | None = None, tail: int | None = None) -> DataFrame:
    """Rows of a log (ts, tool, event) from ``since`` to ``until``, both in, of a tool and event, the last ``tail`` of them.

    Rows without a time are dropped only where a time is asked for.
    """
    if since:
        log = log.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until:
        log = log.filter(F.col("ts") <= F.lit(until).cast("timestamp"))
    if tool:
        log = log.filter(F.col("tool") == tool)
    if event:
        log = log.filter(F.col("event") == event)
    return log.orderBy(F.desc_nulls_last("ts"), *(F.desc(c) for c in log.columns if c in ("id",))).limit(tail) if tail else log
