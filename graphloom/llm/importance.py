"""Operator 5: quality by importance resampling.

Two generative models of hashed n-grams (words, word pairs, byte 4-grams, each ``1 << BITS`` cells with add-one
smoothing): the target from a bounded sample of rows labelled good (``MAX_FIT`` rows and ``MAX_FIT_BYTES`` of text, of all
lengths), the raw one counted over all documents.  A document's log weight is the sum over its n-grams of log(target / raw).
That sum grows with the text, so documents are weighed as if each had ``SPAN`` n-grams: a weight is exp(SPAN * mean log
ratio), which is the sum at a temperature of n_grams / SPAN.  The k largest of log weight plus Gumbel noise, a hash of seed
and id, are drawn: sampling without replacement in proportion to the weights.  k is a parameter; by default it is how many
documents look like the target: those whose mean is at least the level that all but ``MISS`` of the target sample reach.  Which
documents those k are is left to chance and weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, documents, lean, stage
from .hashed import Texts, fold, groups, pairs, sums
from .linear import labelled

BITS, MAX_FIT, MAX_FIT_BYTES = 14, 2000, 16 << 20
#: Share of the target sample that may lie below the floor, and slack under it.
MISS, SLACK = 0.002, 0.05
#: N-grams that each document is weighed for, and the mean log weight that ranks documents without n-grams last.
SPAN, LAST = 20, -1e6


def _items(t: Texts) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    s, _, h = t.words()
    a, b = t.spans(s)
    return [(fold(h, BITS), a, b), (fold(pairs(h, s, t), BITS) + (1 << BITS), a, b), (t.grams(4, BITS) + (2 << BITS), t.start, t.end)]


def counts(texts: list[bytes]) -> np.ndarray:
    """Counts of the n-grams of all the texts."""
    out = np.zeros(3 << BITS, np.int64)
    for a, b in groups(texts):
        for f, x, y in _items(Texts(texts[a:b], lower=False)):
            edge = np.zeros(len(f) + 1, np.int64)
            np.add.at(edge, x, 1)
            np.add.at(edge, y, -1)
            out += np.bincount(f[np.cumsum(edge[:-1]) > 0], minlength=3 << BITS)
    return out


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """``counts`` over all documents: a row a cell and task, summed by cell; the result has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 << BITS, np.int64)
        for batch in batches:
            total += counts([x.encode() for x in batch.column("text").to_pylist()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    made = documents(docs).select("text").mapInArrow(lean(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(3 << BITS, np.int64)
    for r in made.collect():
        out[r.cell] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target / raw) by cell, each kind of n-gram a distribution of its own."""
    t, r = target.reshape(3, -1) + 1.0, raw.reshape(3, -1) + 1.0
    return (np.log(t / t.sum(1, keepdims=True)) - np.log(r / r.sum(1, keepdims=True))).reshape(-1).astype(np.float32)


def log_weights(texts: list[bytes], ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's log weight and number of n-grams."""
    w, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for a, b in groups(texts):
        for f, x, y in _items(Texts(texts[a:b], lower=False)):
            w[a:b] += sums(ratio[f], x, y)
            n[a:b] += y - x
    return w, n


def _kth_value(df: DataFrame, column: str, k: int, bins: int = 4096) -> tuple[object, int]:
    """The k-th smallest value of ``column`` and how many rows are below it; histograms narrow it down, no row is fetched."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    below = 0
    while lo != hi:
        inside = df.filter((F.col(column) >= lo) & (F.col(column) <= hi))
        width = (float(hi) - float(lo)) / bins
        at = F.greatest(F.least(F.floor((F.col(column).cast("double") - float(lo)) / width), F.lit(bins - 1)), F.lit(0)).cast("int") if width > 0 else F.lit(0)
        rows = inside.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        if len(rows) == 1 and (rows[0].lo, rows[0].hi) == (lo, hi):  # too near for a double to tell apart: walk the values
            above = rows[0].n
            while below + (own := df.filter(F.col(column) == lo).count()) < k and above:
                below, above = below + own, above - own
                lo = df.filter(F.col(column) > lo).agg(F.min(column)).first()[0]
            return lo, below
        for r in sorted(rows):
            if below + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            below += r.n
    return lo, below


def first_rows(df: DataFrame, columns: tuple[str, ...], k: int) -> Column:
    """True for the first k rows in the ascending order of ``columns``; where all are equal, for all of them.

    Each column's k-th value is found among the rows that tie in the columns before it.
    """
    if k <= 0:
        return F.lit(False)
    out, tied = F.lit(False), F.lit(True)
    for c in columns:
        value, below = _kth_value(df, c, k)
        out, tied = out | (tied & (F.col(c) < value)), tied & (F.col(c) == value)
        df, k = df.filter(F.col(c) == value), k - below
    return out | tied


def gumbel(seed: int) -> Column:
    """Gumbel noise of a scored row: a hash of seed and id, or, without an id, of seed and content."""
    h = F.when(F.col("_id").isNull(), F.xxhash64(F.lit(seed), F.lit("row"), "n_grams", "log_weight")).otherwise(F.xxhash64(F.lit(seed), "_id"))
    return -F.log(-F.log((F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)))


def weighed(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str], float | None]:
    """_id, n_grams, log_weight, mean_log_weight and the columns ``carry`` under names of their own; those names; the mean from which on a
    document looks like the target (None without labelled good rows)."""
    sample = [t.encode() for t, _ in labelled(docs, labels, "quality", MAX_FIT, MAX_FIT_BYTES, classes=(1,))]
    ratio = log_ratio(counts(sample), corpus_counts(docs)) if sample else np.zeros(3 << BITS, np.float32)
    floor = None
    if sample:
        w, n = log_weights(sample, ratio)
        floor = float(np.quantile((w / np.maximum(n, 1))[n > 0], MISS)) - SLACK if (n > 0).any() else -np.inf
    sent = docs.sparkSession.sparkContext.broadcast(ratio)  # of fixed size: 3 << BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = log_weights([(x or "").encode() for x in batch.column("_text").to_pylist()], sent.value)
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "n_grams": pa.array(n), "log_weight": pa.array(w), **{c: batch.column(c) for c in names.values()}})

    own, names, kinds = carried(docs, carry)
    scored = own.mapInArrow(lean(run), "_id long, n_grams long, log_weight double" + kinds)
    return scored.withColumn("mean_log_weight", F.when(F.col("n_grams") > 0, F.col("log_weight") / F.col("n_grams"))), names, floor


def gumbel_key(seed: int) -> Column:
    """What the k largest of are drawn: the log weight of ``SPAN`` n-grams plus noise."""
    return SPAN * F.coalesce("mean_log_weight", F.lit(LAST)) + gumbel(seed)


def resample(docs: DataFrame, labels: DataFrame, seed: int = 7, k: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_grams, log_weight, mean_log_weight, gumbel_key, sampled: one row a row of ``docs``, with its columns ``carry``.

    Exactly k rows are drawn (all, if there are fewer): ties of keys go by hashes of the row, then by its place.  A null or
    empty text has no n-grams, weight 0 and a null mean, and is drawn after all others.  Rows of one id share their noise;
    rows without an id have noise of their own by their content.  Without labelled good rows all weights are 0 and, unless k is
    given, every row is drawn.  An empty table gives no rows.
    """
    scored, names, floor = weighed(docs, labels, carry)
    scored = scored.withColumn("gumbel_key", gumbel_key(seed))
    # the order of drawing: key, hash, place
    scored = scored.select("*", (-F.col("gumbel_key")).alias("_first"), F.xxhash64("_id", "n_grams", "log_weight").alias("_then"), F.monotonically_increasing_id().alias("_place"))
    scored = stage(scored, "importance")
    if k is None and floor is not None:
        k = scored.filter(F.col("mean_log_weight") >= floor).count()
    drawn = F.lit(True) if k is None or k >= scored.count() else first_rows(scored, ("_first", "_then", "_place"), k)
    return scored.select(F.col("_id").alias("doc_id"), "n_grams", "log_weight", "mean_log_weight", "gumbel_key", drawn.alias("sampled"), *(F.col(n).alias(c) for c, n in names.items() if c != "doc_id"))
