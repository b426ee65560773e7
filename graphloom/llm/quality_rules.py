"""Operator 3: rules on counts, then a calibrated hashed n-gram classifier against a fixed threshold.

The classifier is a logistic regression on shares of hashed character 3- and 4-grams, words and word pairs of the
whole text, fitted on a bounded sample of labelled rows of all lengths (``MAX_FIT`` rows and ``MAX_FIT_BYTES`` of text a class),
its probability calibrated by Platt's method on the fifth of the sample that fitting leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lean
from .linear import calibrate, fit_logistic, labelled, linear_scores, logistic, vectors

MAX_FIT, MAX_FIT_BYTES, BITS = 1500, 8 << 20, 11
#: A text is kept at this probability of good quality or more.
KEEP_AT = 0.3
#: Base rules: fewest words, and most repeated words in a hundred.
MIN_WORDS, MAX_REPEATED = 50, 50
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


@dataclass
class Quality:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, texts: list[bytes]) -> np.ndarray:
        return logistic(self.slope * linear_scores(texts, self.weights, self.bias, BITS) + self.shift)


def train(docs: DataFrame, labels: DataFrame) -> Quality | None:
    """None where the labels do not have both classes: the base rules then decide alone."""
    sample = labelled(docs, labels, "quality", MAX_FIT, MAX_FIT_BYTES)
    y = np.array([q for _, q in sample], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    x = vectors([t.encode() for t, _ in sample], BITS)
    aside = np.arange(len(y)) % 5 == 4
    w, b = fit_logistic(x[~aside], y[~aside])
    a, c = calibrate(x[aside] @ w + b, y[aside]) if len(set(y[aside].tolist())) == 2 else (1.0, 0.0)
    return Quality(w, b, a, c)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode()
    words = raw.split()  # at ASCII white space: space, tab, LF, VT, FF, CR
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    white = raw.count(b" ") + sum(raw.count(c) for c in (b"\t", b"\n", b"\v", b"\f", b"\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    repeated = 0
    if n > 3:
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        v = len(known)
        if v < 2_000_000:
            key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
            order = np.argsort(key, kind="stable")
            s = key[order]
            same = s[1:] == s[:-1]
        else:
            key = np.stack([ids[:-2], ids[1:-1], ids[2:]], 1)
            order = np.lexsort(key.T[::-1])
            same = (key[order][1:] == key[order][:-1]).all(1)
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        covered = np.zeros(n, bool)
        covered[at] = covered[at + 1] = covered[at + 2] = True
        repeated = int(covered.sum())
    symbols = int(SYMBOLS[np.frombuffer(raw, np.uint8)].sum())
    return n, len(text) - white, symbols, len(lines) - len(set(lines)), repeated


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def score(docs: DataFrame, model: Quality | None, keep_at: float = KEEP_AT) -> DataFrame:
    """One row a row of ``docs``, each by its own text whatever its id or its other columns are.

    A null or empty text has no words, fails the base rules and has a null quality.  Texts of any length count whole.  A quality of
    exactly ``keep_at`` is kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 4 << BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED * counts[:, 0])
            p = np.ones(len(texts)) if m is None else m.probability([t.encode() for t in texts])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                **{c: pa.array(counts[:, k]) for k, c in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))},
                "base_failed": pa.array(failed),
                "quality": pa.array(p, mask=counts[:, 0] == 0),
                "kept": pa.array(~failed & (p >= keep_at)),
            })

    return documents(docs).mapInArrow(lean(run), RESULT)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` with a model trained on ``labels``; an empty table gives no rows."""
    return score(docs, train(docs, labels))
