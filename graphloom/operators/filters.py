"""What a request shows: visibility by role and intent, reference branches, external names, changed paths, projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .relational import VISIBLE_TIERS, contains_text

#: Words by which a query asks for rows that are hidden otherwise.
INTENTS = {
    "tests": r"(?i)\b(test|tests|testable|spec|behavior|behaviour|should|fixture|fixtures|mock|mocks)\b", "generated": r"(?i)\b(generated|gen|synthetic)\b",
    "fixtures": r"(?i)\b(fixture|fixtures|mock|mocks|stub|stubs|testdata)\b", "synthetic": r"(?i)\b(lombok|synthetic|generated getter|generated setter)\b",
}
#: File extensions by which a symbol's language is told.
EXTENSIONS = {"java": ("java",), "typescript": ("ts", "tsx"), "javascript": ("js", "jsx", "mjs", "cjs"), "python": ("py",)}
#: Packages that every project imports.
EXTERNAL = ("java", "javax", "jakarta", "org.springframework", "lombok", "org.junit", "org.mockito", "com.fasterxml", "org.slf4j")
#: Types of the standard library whose calls say nothing about a flow.
LIBRARY_OWNERS = (
    "String", "Integer", "Long", "Double", "Float", "Boolean", "Byte", "Short", "Character", "Number", "Math", "System", "Object", "Objects", "Class", "Thread", "Void", "Enum", "Throwable", "Exception", "RuntimeException",
    "StringBuilder", "StringBuffer", "Iterable", "Comparable", "List", "ArrayList", "LinkedList", "Map", "HashMap", "LinkedHashMap", "TreeMap", "Set", "HashSet", "LinkedHashSet", "TreeSet", "Collection", "Collections",
    "Arrays", "Optional", "OptionalInt", "OptionalLong", "Stream", "IntStream", "LongStream", "DoubleStream", "Collectors", "Comparator", "Iterator", "Spliterator", "Deque", "ArrayDeque", "Queue", "PriorityQueue", "Stack",
    "EnumSet", "EnumMap", "BitSet", "UUID", "Random", "Scanner", "StringJoiner", "Function", "Supplier", "Consumer", "Predicate", "BiFunction", "Strings", "StringUtils", "CollectionUtils", "Preconditions", "ObjectUtils",
)
#: Changed paths that can change any test's outcome, and those that can change none.
RUNS_ALL = (
    r"(^|/)pom\.xml$", r"(^|/)build\.gradle(\.kts)?$", r"(^|/)settings\.gradle(\.kts)?$", r"(^|/)gradle\.properties$", r"(^|/)gradle/", r"(^|/)mvnw(\.cmd)?$", r"(^|/)\.mvn/", r"(^|/)package(-lock)?\.json$",
    r"(^|/)(yarn|pnpm-lock)\.(lock|yaml)$", r"(^|/)tsconfig[^/]*\.json$", r"(^|/)(vitest|jest|karma)\.config\.[^/]+$", r"^\.github/", r"(^|/)Dockerfile[^/]*$", r"(^|/)(docker-)?compose[^/]*\.ya?ml$", r"(^|/)src/main/resources/", r"\.(sql|properties)$",
)
IGNORABLE = (r"(^|/)\.graphloom(-[^/]*)?/", r"(?i)\.(md|markdown|adoc|txt)$", r"^docs/", r"(^|/)LICENSE[^/]*$", r"(^|/)\.gitignore$", r"(^|/)\.gitattributes$", r"(^|/)\.editorconfig$", r"(^|/)\.prettierrc[^/]*$", r"(^|/)\.husky/")


def either(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def intent(c: Column, name: str) -> Column:
    """Whether a text asks for what ``name`` stands for; camel case is split for tests."""
    return (T.camel_split(c) if name == "tests" else c).rlike(INTENTS[name])


def shown(query: Column, tests: bool | None = None, generated: bool | None = None, fixtures: bool | None = None, synthetic: bool | None = None) -> dict[str, Column]:
    """What a query shows: what the caller says, else what its words ask for; fixtures come with tests."""
    said = lambda value, name: F.lit(value) if value is not None else intent(query, name)
    out = {"tests": said(tests, "tests"), "generated": said(generated, "generated"), "synthetic": said(synthetic, "synthetic")}
    out["fixtures"] = F.lit(fixtures) if fixtures is not None else out["tests"] | intent(query, "fixtures")
    return out


def role_shown(shows: dict[str, Column], role: str = "role") -> Column:
    r = F.col(role)
    return (shows["tests"] | ~r.eqNullSafe("test_source")) & (shows["generated"] | ~r.eqNullSafe("generated")) & (shows["fixtures"] | ~r.eqNullSafe("mock_source"))


def visible_symbols(rows: DataFrame, query: str, role: str | None = None, language: str | None = None, framework_role: str | None = None, annotation: str | None = None, **show: bool) -> DataFrame:
    """Symbols (role, file, synthetic, framework_role, annotations) that a query shows."""
    shows = shown(F.lit(query), **show)
    keep = role_shown(shows) & (shows["synthetic"] | ~F.coalesce("synthetic", F.lit(False)))
    if role:
        keep &= F.col("role") == role
    if language in EXTENSIONS:
        keep &= either(F.col("file").endswith("." + e) for e in EXTENSIONS[language])
    if framework_role:
        keep &= F.coalesce("framework_role", F.lit("")) == framework_role
    if annotation:
        keep &= F.contains(F.lower(F.array_join("annotations", " ")), F.lit(annotation.lower()))
    return rows.filter(keep)


def visible_references(refs: DataFrame, query: str, low_signal: bool = False, **show: bool) -> DataFrame:
    """References (kind, role, tier, confidence, synthetic) by their branch: calls of visible tiers, field usages of 0.5 or
    more, definitions that are not synthetic; imports by role alone."""
    shows = shown(F.lit(query), **show)
    branch = F.when(F.col("kind") == "definition", shows["synthetic"] | ~F.coalesce("synthetic", F.lit(False)))
    if not low_signal:
        branch = branch.when(F.col("kind") == "call", F.col("tier").isin(*VISIBLE_TIERS)).when(F.col("kind") == "field_usage", F.col("confidence") >= 0.5)
    return refs.filter(role_shown(shows) & branch.otherwise(True))


def graph_roles(rows: DataFrame, tests: bool = False, generated: bool = False, role: str = "role") -> DataFrame:
    """Rows of the roles that an export shows; an unknown role passes."""
    hidden = [] if tests else ["test_source", "mock_source"]
    hidden += [] if generated else ["generated"]
    return rows.filter(F.col(role).isNull() | ~F.col(role).isin(*hidden)) if hidden else rows


def common_external(c: Column) -> Column:
    """An import of a package that every project imports."""
    return either(c.startswith(p + ".") for p in EXTERNAL)


def library_call(callee: Column) -> Column:
    """A call of the standard library; a name without an owner is none."""
    owner = F.element_at(F.split(callee, r"\."), -2)
    return F.coalesce(F.contains(callee, F.lit(".")) & (owner != "") & (callee.rlike(r"(^|\.)javax?\.") | owner.isin(*LIBRARY_OWNERS)), F.lit(False))


def ignorable(path: Column) -> Column:
    return either(path.rlike(p) for p in IGNORABLE)


def runs_all(path: Column) -> Column:
    return either(path.rlike(p) for p in RUNS_ALL)


def with_parameters(rows: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the values given; a value of None or ``ALL`` asks nothing."""
    for name, value in values.items():
        if value is not None and value != "ALL":
            rows = rows.filter(F.col(name) == value)
    return rows


def exists(rows: DataFrame) -> bool:
    """One row is looked for, not all."""
    return not rows.isEmpty()


def from_json_or(c: str, kind: str, fallback: Column) -> Column:
    """A JSON column as ``kind``; broken or missing JSON is ``fallback``."""
    return F.coalesce(F.from_json(F.col(c), kind), fallback)


def symbol_view(rows: DataFrame) -> DataFrame:
    """Symbols with their JSON columns read: parameter_types and annotations as arrays, framework_meta as a map."""
    none = F.array().cast("array<string>")
    return rows.select(
        *(c for c in rows.columns if not c.endswith("_json")), from_json_or("parameter_types_json", "array<string>", none).alias("parameter_types"),
        from_json_or("annotations_json", "array<string>", none).alias("annotations"), from_json_or("framework_meta_json", "map<string,string>", F.create_map().cast("map<string,string>")).alias("framework_meta"),
    )


SLIM = ("file", "line", "col_no", "kind", "name", "source", "caller", "callee", "confidence", "resolution", "tier", "access", "enclosing_class", "enclosing_symbol", "owner", "receiver", "role", "context")


def slim_references(refs: DataFrame, most: int = 160) -> DataFrame:
    """References with the columns that a budget leaves; a context is cut to ``most`` characters."""
    out = refs.select(*(c for c in SLIM if c in refs.columns))
    return out.withColumn("context", F.when(F.length("context") > most, F.concat(F.substring("context", 1, most - 3), F.lit("..."))).otherwise(F.col("context"))) if "context" in out.columns else out


def named_edges(edges: DataFrame, needles: list[str], columns: tuple[str, ...] = ("caller", "callee")) -> DataFrame:
    """Edges of whose ends one equals a needle (``pass`` 0) or contains one (1), whatever the case."""
    exact = either(F.col(c) == n for c in columns for n in needles)
    return edges.filter(either(contains_text(c, n) for c in columns for n in needles)).withColumn("pass", F.when(exact, 0).otherwise(1))
