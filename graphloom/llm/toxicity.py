"""Operator 7: toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of its hashed features (words, and
byte 4-, 5- and 6-grams, lower-case, each counted once a sentence); a document's is that of its worst sentence, so that
no number of clean sentences makes it toxic.  Only documents have labels: fitting goes by the noisy-or of the
sentences, 1 - prod(1 - p), whose gradient reaches all sentences that explain a bag, so the model also tells which
sentences offend.  Fitting uses a bounded sample (``MAX_FIT`` toxic rows and ``MAX_FIT_BYTES``
of them together, ``CLEAN_EACH`` times as much of clean ones, texts of all lengths) of rows outside the held-out fold,
and the features that ``MIN_DOCS`` of its toxic texts have, at least twice as often as clean ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, documents, lean
from .hashed import Texts, fold, groups
from .linear import labelled, logistic

MAX_FIT, MAX_FIT_BYTES, MIN_DOCS, BITS = 1500, 8 << 20, 3, 17
#: Clean rows fitted for each toxic one, and the share of toxic documents that a score of 1/2 supposes.
CLEAN_EACH, PRIOR = 2, 0.2
THRESHOLD = 0.3


@dataclass
class Toxicity:
    weights: np.ndarray  # float32, 4 << BITS
    bias: float


def cuts(raw: bytes) -> np.ndarray:
    """Ends of the sentences; the last is the text's end."""
    ends = [m.end() for m in re.finditer(rb"[.!?]+(?=\s)|\n", raw)]
    if not ends or ends[-1] < len(raw):
        ends.append(len(raw))
    return np.array(ends, np.int64)


def _items(t: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(byte places, features) of each kind; features of kinds do not overlap."""
    s, _, h = t.words()
    inside = np.arange(len(t.raw) - 8)
    return [(s, fold(h, BITS)), *((inside, t.grams(n, BITS) + (k << BITS)) for k, n in ((1, 4), (2, 5), (3, 6)))]


def sentence_sums(texts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The weights' sums by sentence, the first sentence of each text, and the sentences' ends."""
    sums, firsts, ends, done = [], [], [], 0
    for a, b in groups(texts):
        t = Texts(texts[a:b], lower=True)
        own = [cuts(x) for x in texts[a:b]]
        ends += own
        edges = np.concatenate([np.concatenate([[0], e[:-1]]) + s for e, s in zip(own, t.start)])
        stops = np.concatenate([e + s for e, s in zip(own, t.start)])
        z = np.zeros(len(edges))
        for places, f in _items(t):
            total = np.concatenate([[0.0], np.cumsum(weights[f], dtype=np.float64)])
            x, y = np.searchsorted(places, edges), np.searchsorted(places, stops)
            z += total[y] - total[x]
        sums.append(z)
        n = np.fromiter(map(len, own), np.int64, b - a)
        firsts.append(done + np.concatenate([[0], np.cumsum(n)[:-1]]))
        done += int(n.sum())
    return np.concatenate(sums), np.concatenate(firsts), ends


def noisy_or(z: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 - prod(1 - logistic(z)) for each text."""
    quiet = -np.logaddexp(0, z)  # log(1 - logistic(z))
    return -np.expm1(np.add.reduceat(quiet, first))


def worst(z: np.ndarray, first: np.ndarray) -> np.ndarray:
    """logistic(z) of the largest z of each text."""
    return logistic(np.maximum.reduceat(z, first))


def fit(sample: list[tuple[str, int]], steps: int = 150, rate: float = 0.1, l1: float = 1e-4) -> Toxicity | None:
    """None where the sample does not have both classes."""
    y = np.array([v for _, v in sample], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    texts = [t.encode() for t, _ in sample]
    size, n1 = 4 << BITS, float(y.sum())
    # features by the documents of each class that have them
    clean_with, toxic_with = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for a, b in groups(texts):
        t = Texts(texts[a:b], lower=True)
        for places, f in _items(t):
            for d, (x, z) in enumerate(zip(*t.spans(places))):
                (toxic_with if y[a + d] else clean_with)[np.unique(f[x:z])] += 1
    rate1, rate0 = (toxic_with + 0.1) / (n1 + 1), (clean_with + 0.1) / (len(y) - n1 + 1)
    use = (toxic_with >= MIN_DOCS) & (rate1 > 2 * rate0)
    names = np.flatnonzero(use)
    sent, feat, bag, n_sent = [], [], [], 0
    for a, b in groups(texts):
        t = Texts(texts[a:b], lower=True)
        own = [cuts(x) for x in texts[a:b]]
        stops = np.concatenate([e + s for e, s in zip(own, t.start)])
        for d, e in enumerate(own):
            bag += [a + d] * len(e)
        limits = np.stack([t.start, t.end], 1).reshape(-1)
        for places, f in _items(t):
            some = use[f]
            places, f = places[some], f[some]
            real = np.searchsorted(limits, places, side="right") % 2 == 1  # not between texts
            at = np.searchsorted(stops, places[real], side="right") + n_sent
            both = np.unique(at.astype(np.int64) * size + f[real])
            sent.append((both // size).astype(np.int32))
            feat.append((both % size).astype(np.int32))
        n_sent += len(stops)
    sent, col, bag = np.concatenate(sent), np.searchsorted(names, np.concatenate(feat)), np.array(bag)
    first = np.concatenate([[0], np.flatnonzero(bag[1:] != bag[:-1]) + 1])
    w, b = np.zeros(len(names)), -4.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = np.where(y == 1, PRIOR / n1, (1 - PRIOR) / (len(y) - n1))
    for t in range(1, steps + 1):
        z = np.bincount(sent, weights=w[col], minlength=n_sent) + b
        p = np.clip(noisy_or(z, first), 1e-9, 1 - 1e-9)
        # d(log-likelihood)/dz = s (y - P) / P for the sentence's own probability s
        g = -(logistic(z) * ((y - p) / p * weight)[bag])
        gw, gb = np.bincount(col, weights=g[sent], minlength=len(names)) + l1 * np.sign(w), float(g.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    weights = np.zeros(size, np.float32)
    weights[names] = w
    return Toxicity(weights, float(b))


RESULT = "doc_id long, held_out boolean, score double, predicted int, n_sentences int, worst_start int, worst_end int, worst_score double"
RESULT_COLUMNS = tuple(c.split()[0] for c in RESULT.split(", "))


def held_out():
    """Rows that labels are never learnt from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame) -> Toxicity | None:
    return fit(labelled(docs, labels, "toxic", MAX_FIT, MAX_FIT_BYTES, ~held_out(), (CLEAN_EACH, 1)))


def score(docs: DataFrame, model: Toxicity | None, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document with its score and its most offending sentence (byte offsets in the UTF-8 text).

    ``carry`` names columns of ``docs`` that come along, whatever else they are called.
    A null or empty text is one empty sentence.  Without a model (labels of one class) every score is 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 4 << BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value or Toxicity(np.zeros(4 << BITS, np.float32), -50.0)
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column("_text").to_pylist()]
            if not texts:
                continue
            z, first, ends = sentence_sums(texts, m.weights)
            z += m.bias
            p = worst(z, first)
            last = np.append(first[1:], len(z))
            at = [int(np.argmax(z[a:b])) for a, b in zip(first, last)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("_id"), "held_out": batch.column("_out"), "score": pa.array(p),
                "predicted": pa.array((p >= threshold).astype(np.int32)), "n_sentences": pa.array((last - first).astype(np.int32)),
                "worst_start": pa.array([0 if k == 0 else int(e[k - 1]) for k, e in zip(at, ends)], pa.int32()),
                "worst_end": pa.array([int(e[k]) for k, e in zip(at, ends)], pa.int32()),
                "worst_score": pa.array(logistic(z[first + np.array(at)])),
                **{c: batch.column(c) for c in names.values()},
            })

    own, names, kinds = carried(docs, carry, F.coalesce(held_out(), F.lit(False)).alias("_out"))
    out = own.mapInArrow(lean(run), RESULT + kinds)
    return out.select(*(c for c in RESULT_COLUMNS if c not in carry), *(F.col(n).alias(c) for c, n in names.items()))


def toxicity(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``score`` with a model trained on ``labels`` outside the held-out fold; an empty table gives no rows."""
    return score(docs, train(docs, labels), carry=carry)


def offending_sentences(docs: DataFrame, model: Toxicity | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, end (bytes), sentence, score of every sentence at or above the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value or Toxicity(np.zeros(4 << BITS, np.float32), -50.0)
        for batch in batches:
            texts, rows = [x.encode() for x in batch.column("text").to_pylist()], []
            if texts:
                z, first, ends = sentence_sums(texts, m.weights)
                p = logistic(z + m.bias)
                for d, (doc_id, raw, e) in enumerate(zip(batch.column("doc_id").to_pylist(), texts, ends)):
                    for k, stop in enumerate(e.tolist()):
                        if p[first[d] + k] >= threshold:
                            start = int(e[k - 1]) if k else 0
                            rows.append({"doc_id": doc_id, "start": start, "end": stop, "sentence": raw[start:stop].decode("utf-8", "replace"), "score": float(p[first[d] + k])})
            schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("sentence", pa.string()), ("score", pa.float64())])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return documents(docs).mapInArrow(lean(run), "doc_id long, start long, end long, sentence string, score double")
