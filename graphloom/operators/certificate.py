"""Coverage certificates: which keys of a rubric the sections of a composed answer cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rubric keys by name: the sections any of which covers the key, the words any of which covers it, how many rows of
#: evidence make it partial, and its status otherwise.
KEYS = (
    (("handler", "entrypoint", "definitions"), ("symbols", "endpoints"), (), 1, "missing"),
    (("flow", "mode_selection", "handshake", "impact", "dependencies", "usages"), ("flow_steps", "call_edges"), ("own name",), 2, "missing"),
    (("changed_lines", "edit_ranges"), ("edit_ranges", "changed_lines"), (), None, "missing"),
    (("tests",), ("tests",), (), None, "missing"),
    (("risks", "findings"), ("findings", "risk_flags"), ("risk", "finding"), None, "partial"),
    (("validation",), (), ("validation", "command", "test"), None, "partial"),
    (("target_files", "files"), ("files",), (), None, "missing"),
    (("symbols",), ("symbols",), (), None, "missing"),
    (("evidence",), ("evidence",), (), None, "missing"),
)
#: Words that make a key partial.
PARTIAL_WORDS = {"tests": "test"}


def coverage(rubric: DataFrame, sections: DataFrame) -> DataFrame:
    """packet, key, status, found, missing: keys of a rubric (packet, key) against the rows of packets (packet, section, text).

    Named keys go by ``KEYS``.  Another key is cut at underscores: with all its words of three letters or more in the packet's terms it is covered, with
    some, or more than two rows of evidence (section ``evidence``), partial, else missing; without such words it needs evidence.
    ``found`` and ``missing`` are its words.  A word is found if a term holds it; terms of a packet are distinct, so no texts are joined.
    """
    keys = rubric.select("packet", "key").filter("key is not null").distinct()
    counted = sections.groupBy("packet").agg(F.count_if(F.col("section") == "evidence").alias("n_evidence"), F.collect_set("section").alias("sections"))
    terms = sections.select("packet", F.explode(F.split(F.lower("text"), r"[^a-z0-9]+")).alias("term")).filter("term <> ''").distinct()
    named = {k: row for row in KEYS for k in row[0]}
    tokens = F.filter(F.split("key", "_"), lambda t: F.length(t) > 2)
    asked = F.lit(None).cast("array<string>")
    for k, (_, _, words, _, _) in named.items():
        own = [k.replace("_", " ") if w == "own name" else w for w in words] + [w for w in (PARTIAL_WORDS.get(k),) if w]
        asked = F.when(F.col("key") == k, F.array(*map(F.lit, own)) if own else F.array().cast("array<string>")).otherwise(asked)
    asked = F.when(F.col("key").isin(*named), asked).otherwise(tokens)
    wanted = keys.withColumn("asked", asked)
    # few words a packet meet its terms; a name of two words is found if each of them is
    hits = wanted.select("packet", "key", F.explode("asked").alias("word")).withColumn("part", F.explode(F.split("word", " ")))
    hits = hits.join(terms, "packet").filter(F.contains("term", F.col("part"))).groupBy("packet", "key", "word").agg(F.countDistinct("part").alias("n"))
    hits = hits.filter(F.col("n") == F.size(F.array_distinct(F.split("word", " ")))).groupBy("packet", "key").agg(F.array_sort(F.collect_set("word")).alias("found"))
    empty = F.array().cast("array<string>")
    rows = wanted.join(hits, ["packet", "key"], "left").join(counted, "packet", "left").withColumns({"found": F.coalesce("found", empty), "sections": F.coalesce("sections", empty), "n_evidence": F.coalesce("n_evidence", F.lit(0))})
    n, found, status = F.col("n_evidence"), F.size("found"), None
    for k, (_, covering, words, partial, otherwise) in named.items():
        by_section = F.arrays_overlap("sections", F.array(*map(F.lit, covering))) if covering else F.lit(False)
        by_word = (found > 0) if words else F.lit(False)
        out = F.when(by_section | by_word, "covered")
        if k in PARTIAL_WORDS:
            out = out.when(found > 0, "partial")
        if partial is not None:
            out = out.when(n >= partial, "partial")
        out = out.otherwise(otherwise)
        status = F.when(F.col("key") == k, out) if status is None else status.when(F.col("key") == k, out)
    size = F.size("asked")
    default = F.when(size == 0, F.when(n > 0, "covered").otherwise("missing")).when(found == F.size(F.array_distinct("asked")), "covered").when((found > 0) | (n > 2), "partial").otherwise("missing")
    return rows.select("packet", "key", status.otherwise(default).alias("status"), F.array_join("found", " ").alias("found"), F.array_join(F.array_sort(F.array_except("asked", "found")), " ").alias("missing"))


def certificate(covered: DataFrame, strict: bool = True) -> DataFrame:
    """packet, answerable, n_covered, n_partial, n_missing, follow_up: whether a packet's rubric is covered, and which keys to ask for next: those
    missing, else (``strict``) the partial ones."""
    keys = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("key")))), " ")
    n = covered.groupBy("packet").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("covered", "partial", "missing")), keys("missing").alias("m"), keys("partial").alias("p"))
    answerable = (F.col("n_missing") == 0) & ((F.col("n_partial") == 0) | F.lit(not strict))
    return n.select("packet", answerable.alias("answerable"), "n_covered", "n_partial", "n_missing", F.when(answerable, "").when(F.col("n_missing") > 0, F.col("m")).otherwise(F.col("p")).alias("follow_up"))
