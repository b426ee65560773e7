"""Text functions as column expressions: tokens, stems, compact names, escapes, rounding."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a query, in a research question, and in a search for files.
STOP_WORDS = ("a", "an", "and", "by", "class", "code", "for", "from", "in", "java", "jakarta", "method", "of", "or", "service", "spring", "the", "to", "with")
RESEARCH_STOP_WORDS = (*STOP_WORDS, "about", "does", "execute", "explain", "flow", "handle", "happen", "how", "overview", "request", "through", "what", "when", "where", "work", "works",
                       "identify", "find", "locate", "trace", "show", "describe", "determine", "decide", "decides", "responsible", "which", "that", "handled", "fix", "bug")
FILE_STOP_WORDS = (*RESEARCH_STOP_WORDS, "are", "was", "were", "has", "had", "can", "did", "its", "not", "but", "per", "business", "deep", "deepdive", "detail", "details", "dive", "glossary", "mcp", "study")
#: Words too common to mean one file.
BROAD_TERMS = ("app", "application", "business", "codebase", "detail", "details", "flow", "glossary", "hadoop", "hdfs", "implementation", "mcp", "project", "request", "response", "search", "service", "study", "system", "test", "tests")
#: Endings that a stem drops, in order, and what one of two words of a stem may have more than the other.
SUFFIXES = ("izations", "ization", "ations", "ation", "izing", "ings", "ies", "ing", "ers", "ors", "er", "or", "ed", "es", "s")
REMAINDERS = ("e", "s", "es", "d", "ed", "r", "er", "ers", "or", "ors", "ing", "ings", "ion", "ions", "tion", "ation", "al")


def camel_split(c: Column) -> Column:
    c = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2")


def tokens(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct lower-case words of two letters or more, camel case split, stop words dropped, first seen first.

    A word of three letters or more that a split leaves a shorter part of comes whole, too, after its parts.
    """
    def parts(w: Column) -> Column:
        split = F.split(F.lower(camel_split(w)), " +")
        torn = (F.size(split) > 1) & F.exists(split, lambda x: F.length(x) < 3) & (F.length(w) >= 3)
        return F.when(torn, F.concat(split, F.array(F.lower(w)))).otherwise(split)

    words = F.flatten(F.transform(F.filter(F.split(c, "[^A-Za-z0-9]+"), lambda w: w != ""), parts))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop)))


def query_tokens(text: str, stop: tuple[str, ...] = STOP_WORDS) -> list[str]:
    """``tokens`` of a query that the driver knows."""
    out: list[str] = []
    for word in re.findall("[A-Za-z0-9]+", "" if text == "*" else text):
        split = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", word)).lower().split()
        out += split + ([word.lower()] if len(split) > 1 and len(word) >= 3 and min(map(len, split)) < 3 else [])
    return [t for t in dict.fromkeys(out) if len(t) >= 2 and t not in stop]


def identifier_terms(text: str) -> list[str]:
    """Dotted, dashed or underscored lower-case names of four characters or more in a query."""
    return [t for t in dict.fromkeys(re.findall(r"[a-z0-9]+(?:[._-][a-z0-9]+)+", text)) if len(t) >= 4]


def is_broad(term: str) -> bool:
    return len(term) < 3 or term.lower() in BROAD_TERMS


def word_parts(c: Column) -> Column:
    """Lower-case parts of an identifier at camel case and separators."""
    return F.filter(F.split(F.lower(camel_split(c)), "[^a-z0-9]+"), lambda w: w != "")


def compact(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", ""))


def stem(c: Column) -> Column:
    """The word without its first matching suffix, where three characters or more remain; short words as they are."""
    out = F.when(F.length(c) <= 4, c)
    for s in SUFFIXES:
        out = out.when(c.endswith(s) & (F.length(c) - len(s) >= 3), F.substring(c, F.lit(1), F.length(c) - len(s)))
    return out.otherwise(c)


def stem_of(word: str) -> str:
    """``stem`` of a word that the driver knows."""
    word = word.lower()
    return next((word[: -len(s)] for s in SUFFIXES if len(word) > 4 and word.endswith(s) and len(word) - len(s) >= 3), word)


def shares_stem(c: Column, word: str, stemmed: Column | None = None) -> Column:
    """Equal words or stems, or one stem of four characters or more begins the other and the rest is an inflection.

    ``stemmed``: the stem of ``c``, where it is a column already (its expression is long).
    """
    own, s = stem_of(word), stem(c) if stemmed is None else stemmed
    more = s.startswith(own) & F.substring(s, F.lit(len(own) + 1), F.length(s)).isin(*REMAINDERS) if len(own) >= 4 else F.lit(False)
    less = (F.length(s) >= 4) & (F.length(s) < len(own)) & F.startswith(F.lit(own), s) & F.substring(F.lit(own), F.length(s) + 1, F.lit(len(own))).isin(*REMAINDERS)
    return (c == word) | (s == own) | more | less


def lower_camel(c: Column) -> Column:
    """snake_case as lowerCamel."""
    words = F.filter(F.split(c, "_"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))), "")


def parameter_count(c: Column) -> Column:
    """Parameters of a signature: commas at the depth of its own brackets, and one; brackets inside are taken out first."""
    inside = F.regexp_extract(c, r"\((.*)\)", 1)
    for _ in range(4):  # one level of nested brackets at a time
        inside = F.regexp_replace(inside, r"<[^<>()\[\]{}]*>|\([^<>()\[\]{}]*\)|\[[^<>()\[\]{}]*\]|\{[^<>()\[\]{}]*\}", "")
    return F.when(F.trim(inside) == "", 0).otherwise(F.size(F.split(inside, ",")))


def escape_like(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def half_up(c: Column) -> Column:
    """Rounds .5 towards +infinity."""
    return F.floor(c + 0.5)


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def last_segments(c: Column, n: int = 2) -> Column:
    """A dotted name's last ``n`` segments, without a trailing parameter list."""
    return F.substring_index(F.regexp_replace(c, r"\(.*\)$", ""), ".", -n)


def estimated_tokens(c: Column, ratio: float = 4.0) -> Column:
    return F.ceil(F.length(c) / ratio)
