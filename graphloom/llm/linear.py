"""What the trained text models share: labelled samples, dense hashed vectors, logistic regression, calibration."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed import Texts, fold, groups, pairs, sums


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, all_bytes: int, where: Column | None = None, per_class: tuple[float, float] = (1, 1), classes: tuple[int, ...] = (0, 1)) -> list[tuple[str, int]]:
    """A bounded sample for fitting: up to ``most`` times ``per_class`` labelled rows of each class, of all lengths.

    The bytes of a class's texts together are at most ``all_bytes`` times ``per_class``; only rows that no longer fit in are
    passed over.  Rows are taken in the order of a hash of their id, which no label or text decides; contradicting labels
    count as their largest, and of several texts of one id the smallest is taken; only ``classes`` are fetched.  Only fitting is
    bounded; what is scored never is.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    if where is not None:
        marks = marks.filter(where)
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    marks = marks.join(sizes.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id")
    order = F.md5(F.concat(F.lit("fit:"), F.col("doc_id").cast("string")))
    ids = []
    for y in classes:
        room = int(all_bytes * per_class[y])
        for r in marks.filter(F.col("y") == y).orderBy(order, "doc_id").limit(int(most * per_class[y])).collect():
            if r.n <= room:
                ids.append((r.doc_id, r.y))
                room -= r.n
    if not ids:
        return []
    want = dict(ids)
    low = min(want)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id") >= low)
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, y int")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return sorted(((r.text or "", int(r.y)) for r in rows), key=lambda x: (zlib.crc32(x[0].encode()), x))


def vectors(texts: list[bytes], bits: int) -> np.ndarray:
    """Dense features of whole texts: shares of hashed character 3- and 4-grams, words and word pairs (4 << bits columns)."""
    size = 1 << bits
    out = np.zeros((len(texts), 4 * size), np.float32)
    for a, b in groups(texts):
        t = Texts(texts[a:b], lower=False)
        s, _, h = t.words()
        wa, wb = t.spans(s)
        kinds = [t.char_grams(3, bits), t.char_grams(4, bits), (fold(h, bits), wa, wb), (fold(pairs(h, s, t), bits), wa, wb)]
        for k, (index, x, y) in enumerate(kinds):
            for d in range(b - a):
                if y[d] > x[d]:
                    out[a + d, k * size : (k + 1) * size] = np.bincount(index[x[d] : y[d]], minlength=size) / (y[d] - x[d])
    return out


def linear_scores(texts: list[bytes], weights: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """``vectors(texts) @ weights + bias`` without the vectors."""
    w, size = weights.reshape(4, 1 << bits).astype(np.float32), 1 << bits
    out = np.full(len(texts), bias)
    for a, b in groups(texts):
        t = Texts(texts[a:b], lower=False)
        s, _, h = t.words()
        wa, wb = t.spans(s)
        for k, (index, x, y) in enumerate((t.char_grams(3, bits), t.char_grams(4, bits), (fold(h, bits), wa, wb), (fold(pairs(h, s, t), bits), wa, wb))):
            out[a:b] += sums(w[k][index], x, y) / np.maximum(y - x, 1)
    return out


def logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 150, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on all rows at once, classes weighted equally; columns are scaled by their spread."""
    scale = 1 / (x.std(0) + 1e-4)
    n1 = max(int(y.sum()), 1)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / max(len(y) - n1, 1)).astype(np.float32)
    mean = x.mean(0)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    rate /= np.sqrt(x.shape[1])
    for t in range(1, steps + 1):
        ws = w * scale
        g = ((logistic(x @ ws - mean @ ws + b) - y) * weight).astype(np.float32)
        gw = scale * (g @ x - mean * g.sum()) + l2 * w
        gb = float(g.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    w = w * scale
    return w, float(b - mean @ w)


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Platt's a, b: the probability of class 1 is logistic(a * z + b); targets are smoothed by the class counts."""
    n1 = int(y.sum())
    n0 = len(y) - n1
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = logistic(a * z + b)
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        m = np.array([[np.sum(h * z * z) + 1e-6, np.sum(h * z)], [np.sum(h * z), np.sum(h) + 1e-6]])
        da, db = np.linalg.solve(m, [np.sum(g * z), np.sum(g)])
        step = min(1.0, 2 / (abs(da) + abs(db) + 1e-9))
        a, b = a - step * da, b - step * db
    return float(a), float(b)
