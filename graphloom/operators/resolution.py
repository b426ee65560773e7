"""Call resolution: how a raw call is classified, whose method it names, what stays unresolved.

Class chains are closed once (``chains``: every class with its ancestors by distance, and with its enclosing classes'), and
a call is then an equi-join with the methods or fields of the chain, the nearest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import ancestors

#: Names that tests call without an owner and that tell nothing about a flow.
LOW_SIGNAL = (
    "assertArrayEquals", "assertEquals", "assertFalse", "assertNotEquals", "assertNotNull", "assertNull", "assertSame", "assertThat", "assertThrows", "assertTrue", "containsString", "empty", "equalTo", "expectThrows", "fail",
    "greaterThan", "greaterThanOrEqualTo", "hasSize", "instanceOf", "is", "lessThan", "lessThanOrEqualTo", "mock", "never", "not", "notNullValue", "nullValue", "randomAlphaOfLength", "randomBoolean", "randomFrom", "randomInt",
    "randomIntBetween", "sameInstance", "verify", "when",
)
NAME = r"^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*$"


def edge_fault(longest: int | None = 2048) -> Column:
    """Why a call is no edge: no name at an end, a line break or more than ``longest`` characters there (None: any length); null for others."""
    bad = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", "no name").when(F.trim(c).rlike(r"[\r\n]"), "line break").when(F.lit(longest is not None) & (F.length(F.trim(c)) > F.lit(longest or 0)), "too long")
    return F.coalesce(bad("caller"), bad("callee"))


def left_out(calls: DataFrame, longest: int | None = 2048) -> DataFrame:
    """fault, n: calls that ``classified`` leaves out."""
    return calls.groupBy(edge_fault(longest).alias("fault")).agg(F.count(F.lit(1)).alias("n")).filter("fault is not null")


def classified(calls: DataFrame, longest: int | None = 2048) -> DataFrame:
    """Calls (caller, callee, confidence, resolution) with tier, reasons and confidence by what is known of them.

    Calls with an ``edge_fault`` are no edges (``left_out`` counts them).
    """
    ends = [F.trim(c) for c in ("caller", "callee")]
    rows = calls.filter(edge_fault(longest).isNull()).withColumns({"caller": ends[0], "callee": ends[1]})
    provided = F.col("resolution").eqNullSafe("scip-reference")
    reasons = F.array_compact(F.array(
        F.when(~F.col("caller").rlike(NAME), "caller is an expression"), F.when(~F.col("callee").rlike(NAME), "callee is an expression"),
        F.when(F.col("callee").isin(*LOW_SIGNAL), "low-signal unqualified helper call"),
    ))
    rows = rows.withColumn("reasons", F.when(provided, F.array(F.lit("semantic provider fact"))).otherwise(reasons))
    low, base = F.size("reasons") > 0, F.coalesce("confidence", F.lit(0.4))
    sure = F.when(provided, F.greatest(base, F.lit(0.9))).when(low, F.least(base, F.lit(0.25))).otherwise(base)
    return rows.withColumns({"tier": F.when(provided, "provider").when(low, "low_signal").otherwise("primary"), "confidence": sure})


def chains(extends: DataFrame, classes: DataFrame) -> DataFrame:
    """class, owner, depth: each class with itself (0) and every superclass (``extends``: child, parent)."""
    own = classes.selectExpr("class", "class AS owner", "0 AS depth")
    return own.union(ancestors(extends).selectExpr("child AS class", "ancestor AS owner", "depth")).groupBy("class", "owner").agg(F.min("depth").alias("depth"))


def visible_owners(extends: DataFrame, outer: DataFrame, classes: DataFrame) -> DataFrame:
    """class, owner, place: the classes whose members a method of ``class`` sees by their bare name, nearest first: its own
    chain, then that of each enclosing class (``outer``: child, parent)."""
    up = chains(extends, classes)
    around = classes.selectExpr("class", "class AS around", "0 AS level").union(ancestors(outer).selectExpr("child AS class", "ancestor AS around", "depth AS level"))
    seen = around.join(up.withColumnRenamed("class", "around"), "around")
    return seen.groupBy("class", "owner").agg(F.min(F.struct("level", "depth")).alias("place"))


def owner_of_caller(caller: Column) -> Column:
    """The class part of a caller's name: all but its last segment, without parameters."""
    return F.regexp_replace(F.regexp_replace(caller, r"\([^)]*\)$", ""), r"\.?[^.]*$", "")


def resolved_owners(calls: DataFrame, methods: DataFrame, fields: DataFrame, extends: DataFrame, outer: DataFrame) -> DataFrame:
    """Calls (caller, callee) with ``resolved``, ``how`` and ``sure``.

    A bare name, or one of ``this``, is looked for along the chain of the caller's class, a bare one in enclosing
    classes, too, and one of ``super`` from the superclass up (0.82); a receiver that names a visible field is the field's
    type (0.80), and a capitalised receiver a type (0.80).  ``methods``: owner, method; ``fields``: owner, field, type.
    """
    rows = calls.select("*", owner_of_caller(F.col("caller")).alias("class"), F.regexp_extract("callee", r"^(.*)\.", 1).alias("receiver"), F.substring_index("callee", ".", -1).alias("method"))
    rows = rows.withColumn("mode", F.when(F.col("receiver") == "", "bare").when(F.col("receiver").isin("this", "super"), F.col("receiver")).when(F.col("receiver").rlike("^[A-Z][A-Za-z0-9_$]*$"), "type").when(F.col("receiver").rlike("^[A-Za-z_$][A-Za-z0-9_$]*$"), "field").otherwise("none"))
    seen = visible_owners(extends, outer, rows.select("class").distinct())
    owned = seen.join(methods.select("owner", "method").distinct(), "owner")
    level, depth = F.col("place.level"), F.col("place.depth")
    best = lambda df: F.min(F.struct("place", "owner")).alias(df)
    hit = owned.groupBy("class", "method").agg(best("bare"), F.min(F.when(level == 0, F.struct("place", "owner"))).alias("this"), F.min(F.when((level == 0) & (depth > 0), F.struct("place", "owner"))).alias("super"))
    typed = seen.join(fields, "owner").groupBy("class", F.col("field").alias("receiver")).agg(F.min(F.struct("place", "owner", "type")).alias("f"))
    rows = rows.join(hit, ["class", "method"], "left").join(typed, ["class", "receiver"], "left")
    owner = F.when(F.col("mode") == "bare", F.col("bare.owner")).when(F.col("mode") == "this", F.col("this.owner")).when(F.col("mode") == "super", F.col("super.owner")).when(F.col("f.type").isNotNull(), F.col("f.type")).when(F.col("mode") == "type", F.col("receiver"))
    how = F.when(F.col("mode").isin("bare", "this"), "enclosing-method").when(F.col("mode") == "super", "super-method").when(F.col("f.type").isNotNull(), "receiver-field").otherwise("static-or-type-receiver")
    sure = F.when(F.col("mode").isin("bare", "this", "super"), 0.82).otherwise(0.8)
    found = owner.isNotNull()
    return rows.select(*calls.columns, F.when(found, F.concat_ws(".", owner, "method")).alias("resolved"), F.when(found, how).alias("how"), F.when(found, sure).alias("sure"))


def bare_names(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (file, callee, tier, resolution, confidence, ...) with bare names resolved to symbols (fq_name, name, kind, file, role).

    Only primary calls by name alone and without a dot: to the first function or method of that name in the same file (0.8), else to the only
    one of that name anywhere (0.75).  Symbols count if they are of the main or generated source; what is ambiguous stays as it is.
    """
    own = symbols.filter(F.col("kind").isin("function", "method") & F.col("role").isin("main_source", "generated")).select("fq_name", "name", "file")
    local = own.groupBy("file", F.col("name").alias("callee")).agg(F.min("fq_name").alias("_local"))
    only = own.groupBy(F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("_n"), F.min("fq_name").alias("_only")).filter("_n = 1").drop("_n")
    rows = calls.join(local, ["file", "callee"], "left").join(only, "callee", "left")
    bare = (F.col("resolution") == "name-only") & (F.col("tier") == "primary") & ~F.contains("callee", F.lit("."))
    near, far = bare & F.col("_local").isNotNull(), bare & F.col("_only").isNotNull()
    pick = lambda a, b, c: F.when(near, a).when(far, b).otherwise(c)
    new = {"callee": pick(F.col("_local"), F.col("_only"), F.col("callee")), "resolution": pick(F.lit("name-local"), F.lit("name-unique"), F.col("resolution")), "confidence": pick(F.lit(0.8), F.lit(0.75), F.col("confidence"))}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in calls.columns))


def unresolved_imports(imports: DataFrame, symbols: DataFrame, external: Column, most: int = 200, top: int = 20) -> DataFrame:
    """source, n: imports of no type that is known by its full or last name, of the ``most`` frequent ones."""
    n = imports.filter(~external).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(most)
    known = symbols.filter(F.col("kind").isin("class", "interface", "enum", "type")).select(F.explode(F.array("fq_name", "name")).alias("known")).distinct()
    last = F.element_at(F.filter(F.split("source", r"\."), lambda x: x != ""), -1)
    left = n.join(known, F.col("source") == F.col("known"), "left_anti").withColumn("last", last)
    return left.join(known, F.col("last") == F.col("known"), "left_anti").orderBy(F.desc("n"), "source").limit(top).select("source", "n")


def not_called(fields: DataFrame, texts: DataFrame) -> DataFrame:
    """Fields (name, type) that look like services and whose type and name no called text (``text``) contains.

    Containment is an equi-join with substrings of the lengths that the fields' names have (a few dozen).  A name of identifier
    characters can only be within one of the texts' identifiers, so only their vocabulary is cut; whole texts are cut for other names.
    """
    kind = F.trim(F.regexp_replace(F.coalesce("type", F.lit("")), "<.*>$", ""))
    like = F.when(kind != "", kind).otherwise(F.concat(F.upper(F.substring("name", 1, 1)), F.substring(F.col("name"), F.lit(2), F.length("name"))))
    rows = fields.withColumn("service", like).filter(F.col("service").rlike("(Service|Client|Gateway|Repository|Dao|Manager)$"))
    needles = rows.select(F.explode(F.array(F.lower("service"), F.lower("name"))).alias("needle")).distinct()
    plain = F.col("needle").rlike(f"^{_PLAIN}$")
    lengths = needles.groupBy(plain.alias("plain"), F.length("needle").alias("n")).count().collect()  # as many as names have lengths
    called = None
    for is_plain in {r.plain for r in lengths}:
        own = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_PLAIN), F.lit(0))).alias("t")) if is_plain else texts.select(F.lower("text").alias("t"))
        inside = own.distinct().select(F.explode(F.array_distinct(F.concat(*(_cuts(F.col("t"), r.n) for r in sorted(lengths) if r.plain == is_plain)))).alias("needle")).distinct()
        hit = needles.filter(plain == is_plain).join(inside, "needle", "left_semi")
        called = hit if called is None else called.union(hit)
    if called is None:
        return rows
    out = rows.join(called.withColumnRenamed("needle", "n1"), F.lower("service") == F.col("n1"), "left_anti")
    return out.join(called.withColumnRenamed("needle", "n2"), F.lower("name") == F.col("n2"), "left_anti")


_PLAIN = "[a-z0-9_$.]+"


def _cuts(t: Column, n: int) -> Column:
    """The substrings of ``n`` characters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1)))
    return F.when(F.length(t) >= n, F.transform(at, lambda k: F.substring(t, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def lookup_terms(symbol: str) -> list[str]:
    """The names under which calls of a symbol are looked up: whole, without parameters, last two segments, a constructor's owner."""
    import re

    raw = symbol.strip()
    bare = re.sub(r"\([^)]*\)$", "", raw).strip()
    parts = [p for p in re.split(r"[.#]", bare) if p]
    dotted = [p for p in bare.split(".") if p]
    short = ".".join(dotted[-2:]) if len(dotted) >= 2 else bare
    exact = [t for t in (bare, short, ".".join(parts[-2:]) if len(parts) >= 2 else "") if len(t) >= 4 and not T.is_broad(t)] if len(bare) >= 4 else []
    owner = [p for p in bare[: -len(".new")].split(".") if p][-1:] if bare.endswith(".new") else []
    return [t for t in dict.fromkeys([*exact, short, bare, raw, *owner]) if len(t) >= 3 and not T.is_broad(t)][:6]
