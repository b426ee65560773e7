"""Operator 13: which terms a source of a language uses more than the language, and how far its sources lie apart.

Terms are counted in tasks and added up.  A term's share in a group (a source within a language) and in the language is an
integer of parts in a billion, smoothed by two; f(p, q) = floor((p - q)^2 / (p + q)).

*Terms*: a group's terms are dealt to buckets by count.  A bucket's largest p and the least probability that the language gives
to any of its terms bound f in it, as f grows with p and falls with q.  Buckets are evaluated best bound first, in waves each about
``GROWTH`` times the last; a group is done once all its unseen bounds are strictly below its k-th value.

*Pairs*: only sources that have a term meet in its posting.  The sum over all terms is taken as if no term were shared: each
count's number of terms times f against the other source's share of an absent term.  Postings then correct it for
each shared term.  A posting holds the sources of a pair of blocks of ``BLOCK``, so that it stays small however many sources there are; its
pairs are added up in a matrix within the task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, rows_per_group, small_batches, stage, unstage

#: Documents of a language that a kept term is in; terms reported for a group.
MIN_DOCS, TOP = 10, 10
#: Count buckets to a doubling; how much each wave grows; sources of a block; terms a task holds before it hands them on.
STEPS, GROWTH, BLOCK, HELD = 8, 4, 256, 400_000
#: Bytes of a long text that are split into terms at once.
SLICE = 4 << 20
SCALE = 1_000_000_000

_FORM = bytearray(b" " * 256)
_FORM[0x41:0x5B] = _FORM[0x61:0x7B] = bytes(range(0x61, 0x7B))
_FORM[0x80:] = bytes(range(0x80, 0x100))
_FORM = bytes(_FORM)


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = len(text) if at + SLICE >= len(text) else max(text.rfind(b" ", at, at + SLICE), at)
        if end == at and (end := text.find(b" ", at + SLICE)) < 0:
            end = len(text)
        yield text[at:end]
        at = end + 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of a task's rows; a row without a term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [])
        for (lang, source), (n, docs) in held.items():
            out[2].append(b"")
            out[2].extend(n)
            out[3].append(0)
            out[3].extend(n.values())
            out[4].append(0)
            out[4].extend(docs[t] for t in n)
            more = len(out[2]) - len(out[0])
            out[0].extend([lang] * more)
            out[1].extend([source] * more)
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(x, k) for x, k in zip(out, kinds)]
        return pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.string()), *arrays[3:]], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for part in _slices(text.translate(_FORM)):
                terms = part.split()
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(x[0]) for x in held.values()) > HELD:
            yield rows()
            held = {}
    yield rows()


def f_value(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _share(count: str, total: str, terms: str) -> Column:
    """Parts in a billion, exact: the product can be larger than a long."""
    whole = f"(cast({total} as decimal(38, 0)) + 2 * {terms})"
    return F.expr(f"case when {terms} > 0 then 1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 2 as decimal(20, 0))) div cast({whole} as decimal(38, 0)) end")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b (a < b), v: what postings add to the sums as if no term were shared, summed by run of a language and pair of blocks."""
    now, sources, total = None, {}, np.zeros((0, 0), np.int64)
    f = lambda p, q: (p - q) ** 2 // (p + q)

    def rows() -> pa.RecordBatch:
        names = sorted(sources)
        at = np.array([sources[x] for x in names], np.int64)
        own = total[np.ix_(at, at)]
        a, b = np.nonzero(own)  # a zero adds nothing
        name = pa.array(names, pa.string())
        return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(a), pa.string()), name.take(pa.array(a)), name.take(pa.array(b)), pa.array(own[a, b])], names=["lang", "a", "b", "v"])

    for batch in batches:
        for lang, i, j, posting in zip(*(batch.column(c).to_pylist() for c in ("lang", "i", "j", "posting"))):
            if (lang, i, j) != now:
                if now is not None and sources:
                    yield rows()
                now, sources, total = (lang, i, j), {}, np.zeros((0, 0), np.int64)
            if len(posting) < 2:
                continue
            posting.sort(key=lambda x: x["source"])  # by code point: the order of names, so that a < b
            at = np.array([sources.setdefault(x["source"], len(sources)) for x in posting], np.int64)
            if len(sources) > len(total):
                larger = np.zeros((2 * len(sources), 2 * len(sources)), np.int64)
                larger[: len(total), : len(total)] = total
                total = larger
            p, absent, block = (np.array([x[c] for x in posting], np.int64) for c in ("p", "absent", "block"))
            v = f(p[:, None], p[None]) - f(p[:, None], absent[None]) - f(absent[:, None], p[None]) + f(absent[:, None], absent[None])
            v = np.triu(v, 1)
            if i != j:  # pairs within a block have a posting of their own
                v[block[:, None] == block[None]] = 0
            total[np.ix_(at, at)] += v
    if now is not None and sources:
        yield rows()


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: every two sources of a language."""
    most = groups.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    blocks, salts = rows_per_group(most, BLOCK), 32
    own = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    entry = F.struct("source", "p", "absent", F.col("block"))
    postings = kept.withColumn("block", own).withColumn("other", other)
    postings = postings.groupBy("lang", "term", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(entry).alias("posting"))
    postings = postings.sortWithinPartitions("lang", "i", "j").select("lang", "i", "j", "posting")
    shared = postings.mapInArrow(lean(_shared), "lang string, a string, b string, v long").groupBy("lang", "a", "b").agg(F.sum("v").alias("shared"))
    # as if no term were shared: a row for each count of a source, against each other source of the language
    counts = kept.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k")).withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(salts)).cast("int"))
    others = groups.filter("terms > 0").select("lang", F.col("source").alias("item"), F.col("absent").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    alone = counts.join(others, ["lang", "salt"]).filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("k") * f_value("p", "q")).alias("alone"))
    # each two sources once, with both sides' sums
    a, b = F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")
    alone = alone.groupBy("lang", a, b).agg(F.sum("alone").alias("alone"))
    x = groups.select("lang", F.col("source").alias("a"), F.col("own_terms").alias("na"), F.col("absent").alias("qa"), "terms")
    y = groups.select("lang", F.col("source").alias("b"), F.col("own_terms").alias("nb"), F.col("absent").alias("qb"))
    two = x.join(y, "lang").filter("a < b").join(alone, ["lang", "a", "b"], "left").join(shared, ["lang", "a", "b"], "left")
    neither = (F.col("terms") - F.col("na") - F.col("nb")) * f_value("qa", "qb")
    value = F.when(F.col("terms") > 0, F.coalesce("alone", F.lit(0)) + F.coalesce("shared", F.lit(0)) + neither).otherwise(F.lit(0))
    two = two.select("lang", "a", "b", value.cast("long").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e")
    return two.select("lang", both, "value").select("lang", "e.source", "e.item", "value")


def _top_terms(kept: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value: each group's first ``top`` terms that it uses more than its language, best bounds first."""
    group = ("lang", "source")
    bound = F.when(F.max("p") > F.min("q"), f_value("max(p)", "min(q)"))
    buckets = kept.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("n"), bound.alias("bound")).filter("bound is not null")
    seen = F.coalesce(F.sum("n").over(W.partitionBy(*group).orderBy(F.desc("bound"), "bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wave = F.when(seen < top, 0).otherwise(1 + F.floor(F.log(seen / top) / F.log(F.lit(GROWTH))))
    buckets = stage(buckets.withColumn("wave", wave.cast("int")), "buckets")
    last = buckets.agg(F.max("wave")).first()[0]
    found, opened = None, None
    for k in range(0, -1 if last is None else last + 1):
        chosen = buckets.filter(F.col("wave") == k).select(*group, "bucket")
        chosen = chosen if opened is None else chosen.join(opened, list(group), "left_semi")
        rows = kept.join(chosen, [*group, "bucket"]).filter("p > q").select(*group, F.col("term").alias("item"), f_value("p", "q").alias("value"))
        rows = rows if found is None else found.union(rows)
        first = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("value"), "item"))
        was, found = found, stage(rows.withColumn("r", first).filter(F.col("r") <= top).drop("r"), "top-terms")
        if k == last:
            break
        kth = found.groupBy(*group).agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("kth"))
        unseen = buckets.filter(F.col("wave") > k).groupBy(*group).agg(F.max("bound").alias("bound"))
        unseen = unseen if opened is None else unseen.join(opened, list(group), "left_semi")
        before = opened
        opened = stage(unseen.join(kth, list(group), "left").filter(F.coalesce(F.col("c") < top, F.lit(True)) | (F.col("bound") >= F.col("kth"))).select(*group), "open-groups")
        unstage(*(x for x in (was, before) if x is not None))
        if opened.isEmpty():
            break
    return found if found is not None else kept.filter("false").select(*group, F.col("term").alias("item"), F.col("p").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part 'pair' ranks a source's distances to all others of its language, 'term' its first terms.

    Null text, lang and source count as ''.  Rows of one id are documents of their own; ties of a value go by the item's UTF-8
    bytes.  A language without kept terms has pairs of value 0 and no terms; an empty table gives no rows.  Texts of any
    length count whole.
    """
    small_batches(docs.sparkSession)
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    made = own.mapInArrow(lean(_counted), "lang string, source string, term string, n long, docs long")
    counts = stage(made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    words = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term", "n_lang")
    shared = stage(counts.select("lang", "source", "term", "n").join(words, ["lang", "term"]), "kept-terms")
    langs = words.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n_lang").alias("lang_total"))
    totals = shared.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own_terms"))
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "own_terms", "terms", "lang_total"])
    groups = stage(groups.withColumn("absent", _share("0", "total", "terms")), "groups")
    kept = shared.join(groups.select("lang", "source", "total", "terms", "lang_total", "absent"), ["lang", "source"])
    bucket = F.floor(F.log2(F.col("n").cast("double")) * STEPS).cast("int")
    kept = stage(kept.select("lang", "source", "term", _share("n", "total", "terms").alias("p"), _share("n_lang", "lang_total", "terms").alias("q"), "absent", bucket.alias("bucket")), "shares")
    unstage(shared)
    pairs = _pairs(kept, groups).withColumn("part", F.lit("pair"))
    terms = _top_terms(kept, top).withColumn("part", F.lit("term")).select(*pairs.columns)
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.union(terms).select("lang", "source", "part", "item", "value", rank.alias("rank"))
