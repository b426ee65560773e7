"""Full-text search: postings, BM25, tiered symbol scores, keyword search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

K1, B = 1.2, 0.75


def query_terms(text: str, most: int = 12) -> list[str]:
    """Distinct lower-case tokens of three characters or more."""
    import re

    return list(dict.fromkeys(t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) >= 3))[:most]


def phrase_counts(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, len, tf0, tf1, ...: a document's words and how many begin with each term.

    Words are laid one space apart; a word that begins with a term is then the term behind a space, and counting is one
    replacement and two lengths, all of it compiled.
    """
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")))
    n = lambda t: ((F.length("s") - F.length(F.replace(F.col("s"), F.lit(t), F.lit("")))) / len(t)).cast("int")
    rows = docs.select(key, spaced.alias("s"))
    return rows.select(key, F.when(F.col("s") == " ", 0).otherwise(n(" ")).alias("len"), *(n(f" {t}").alias(f"tf{k}") for k, t in enumerate(terms)))


def bm25(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, score: sum over the query's prefixes of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)).

    A prefix is one phrase: its tf counts all words that start with it.  Texts are read once: their counts are written,
    and both the statistics and the scores come from those.  idf is floored at 1e-6.
    """
    terms = query_terms(query)
    rows = written(phrase_counts(docs, key, text, terms), "counts")
    stats = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    score: Column = F.lit(0.0)
    hit: Column = F.lit(False)
    for k in range(len(terms)):
        f, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.greatest(F.log((F.col("n_docs") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        hit = hit | (f > 0)
    found = rows.filter(hit).join(F.broadcast(stats))  # stats is one row
    return found.select(key, score.alias("score"))


def symbol_score(name: Column, fq_name: Column, query: str) -> Column:
    """The score's tiers: exact 120, compact 112, phrase 98, every token 88 (name) or 74 (full name), else by their share."""
    low, toks = query.lower(), query_terms(query)
    compact = "".join(c for c in low if c.isalnum())
    n, q = F.lower(name), F.lower(fq_name)
    hits = sum((F.when(q.contains(t), 1).otherwise(0) for t in toks), F.lit(0))
    every = lambda c: F.lit(bool(toks)) if not toks else _all([c.contains(t) for t in toks])
    return (
        F.when(n == low, 120).when(F.regexp_replace(n, "[^a-z0-9]+", "") == compact, 112).when(n.contains(low), 98).when(every(n), 88).when(every(q), 74)
        .otherwise(F.floor(40 + 30 * hits / max(len(toks), 1) + 0.5))
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def keyword_search(rows: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, hits, score: rows with a stem (a word's first five letters) of the query, weighed by 1 + ln(N / df)."""
    stems = list(dict.fromkeys(t[:5] for t in query_terms(query)))[:6]
    flags = rows.select(key, *[F.lower(text).contains(s).cast("int").alias(f"h{k}") for k, s in enumerate(stems)])
    stats = flags.agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(f"h{k}").alias(f"d{k}") for k in range(len(stems))])
    score = sum((F.col(f"h{k}") * (1 + F.log(F.col("n_rows") / F.greatest(F.col(f"d{k}"), F.lit(1)))) for k in range(len(stems))), F.lit(0.0))
    hits = sum((F.col(f"h{k}") for k in range(len(stems))), F.lit(0))
    return flags.join(F.broadcast(stats)).select(key, hits.alias("hits"), score.alias("score")).filter("hits > 0")


def relevant_tests(files: DataFrame, symbols: DataFrame, calls: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """file, score: test files (role) by 4 points for a path, 3 for a symbol and 6 for a call that names a term; ``terms`` has the exact
    names of calls for each term."""
    test = F.col("role").isin("test_source", "mock_source")
    low = lambda c: F.lower(F.col(c))
    points = lambda hits: sum((F.when(h, n).otherwise(0) for h, n in hits), F.lit(0))
    f = files.filter(test).select(F.col("path").alias("file"), points((low("path").contains(t.lower()), 4) for t in terms).alias("n"))
    names = [F.max(low("name").contains(t.lower()) | low("fq_name").contains(t.lower())).alias(f"t{k}") for k, t in enumerate(terms)]
    s = symbols.filter(test).groupBy("file").agg(*names).select("file", points((F.col(f"t{k}"), 3) for k in range(len(terms))).alias("n"))
    named = [F.max(F.col("caller").isin(*exact) | F.col("callee").isin(*exact)).alias(f"t{k}") for k, exact in enumerate(terms.values())]
    c = calls.filter(test).groupBy("file").agg(*named).select("file", points((F.col(f"t{k}"), 6) for k in range(len(terms))).alias("n"))
    return f.union(s).union(c).groupBy("file").agg(F.sum("n").alias("score")).filter("score > 0").orderBy(F.desc("score"), "file")


def _weighed_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    words = docs.select(key, F.explode(F.split(F.lower(text), "[^a-z0-9]+")).alias("term")).filter(F.length("term") >= 3)
    return words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("weight"))


def term_artifact(docs: DataFrame, key: str, text: str, most: int | None = 160) -> DataFrame:
    """key, term, weight: the ``most`` frequent words of three letters or more of each document (None: all): what is left to search by
    when there is no index.  ``terms_left_out`` counts the others."""
    from .relational import top_per_key

    return top_per_key(_weighed_terms(docs, key, text), [key], [F.desc("weight"), F.col("term")], most).drop("rn")


def terms_left_out(docs: DataFrame, key: str, text: str, most: int | None = 160) -> DataFrame:
    """key, n, left_out: terms of each document, and those beyond its artifact."""
    from .relational import left_out

    return left_out(_weighed_terms(docs, key, text), [key], most)


def artifact_ranking(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, score, matched: documents by the weights of the terms in their artifact."""
    hits = term_artifact(docs, key, text).filter(F.col("term").isin(*terms))
    return hits.groupBy(key).agg(F.sum("weight").alias("score"), F.array_join(F.sort_array(F.collect_list("term")), " ").alias("matched"))


def live_scan(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, hits, first_line: a scan of the lines themselves, a hit for each term that a line holds."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("k", "l"))
    n = sum((F.contains(F.lower("l"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    return lines.select(key, "k", n.alias("n")).filter("n > 0").groupBy(key).agg(F.sum("n").alias("hits"), (F.min("k") + 1).cast("bigint").alias("first_line"))
