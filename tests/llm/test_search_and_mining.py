"""Operators 11 to 13 against plain Python, and their odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from graphloom.llm import decontaminate, divergence, hard_negatives
from graphloom.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One two three."), (4, "One two three."), (5, "one  two\nthree."), (6, "x" * 5000), (7, "é " * 3000), (None, "no id")]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, row long, runs string, term string, n long, cell long"
MEGABYTES = "the passage of ten words that is found at last here. " * 40_000 + "one two three four five six seven eight nine ten"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i == 5 else "s", None if i == 6 else "en", 1, 0, "r", "t", 2, 3) for i, t in [*ODD, (8, MEGABYTES), (9, MEGABYTES)]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- operator 12


def brute_hits(text, items, width=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hit, found = set(), set()
    places = defaultdict(list)
    for k, w in enumerate(words):
        places[w].append(k)
    for i, t in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        size = min(len(own), width)
        for k in range(len(own) - size + 1) if own else []:
            for s in places[own[k]]:
                if words[s : s + size] == own[k : k + size]:
                    hit |= set(range(s, s + size))
                    found.add("" if i is None else str(i))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def mixed_texts(rng, n):
    vocabulary = ["a", "b", "the", "é", "ñx", "x9", "longerword", "thth", "inin", "of", "İ"]
    return ["".join(rng.choice(vocabulary) + rng.choice([" ", "  ", ". ", "\n", "-", "\x7f"]) for _ in range(rng.randint(0, 300))) for _ in range(n)]


@pytest.mark.parametrize("width,block_bytes", [(10, 1 << 20), (10, 900), (3, 1000), (1, 1 << 20)])
def test_contamination(spark, width, block_bytes):
    rng = random.Random(width)
    texts = mixed_texts(rng, 60)
    items = [(k, t) for k, t in enumerate(mixed_texts(rng, 12))] + [(100 + k, " ".join(rng.choice(["a", "of", "the"]) for _ in range(k))) for k in range(5)]
    for k in range(20):  # passages of the texts, in capitals
        words = rng.choice(texts).split()
        if len(words) > 40:
            at = rng.randint(0, len(words) - 40)
            items.append((200 + k, " ".join(words[at : at + rng.randint(1, 40)]).replace("the", "THE")))
    items += [(7, None), (None, "b b b b of"), (3, items[5][1]), (8, "..."), (9, "")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digests(decontaminate.contamination(docs, bench, width, block_bytes)).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == {k: brute_hits(t, items, width) for k, t in enumerate(texts)}
    assert len(got) == len(texts) and (width == 10 or any(r.contaminated for r in got))


def test_contamination_runs_and_long_items(spark, monkeypatch):
    """Long items are searched in pieces without losing a window; runs name the hit words."""
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 300)}" for _ in range(3000)]
    docs = spark.createDataFrame([(k, " ".join(["zz", *words[k * 97 : k * 97 + 10], "zz", "zz", *words[500:530]])) for k in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    whole = {r.doc_id: [(x.a, x.b) for x in r.runs] for r in decontaminate.contamination(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 64)
    parts = {r.doc_id: [(x.a, x.b) for x in r.runs] for r in decontaminate.contamination(docs, bench, block_bytes=2000).collect()}
    assert whole == parts == {k: [(1, 11), (13, 43)] for k in range(30)}


def test_contamination_of_odd_rows(spark, odd, none):
    items = [(1, "one two three"), (2, "One, two three four five six seven eight nine ten"), (3, "the passage of ten words that is found at last"), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [*ODD, (8, MEGABYTES), (9, MEGABYTES)]
    want = Counter((i, *brute_hits(t, items)) for i, t in rows[:-2])
    n = 11 * 40_000 + 10
    want[(8, n, 10 * 40_000 + 10, 3, hashlib.sha256(b"1,2,3").hexdigest(), True)] = 1
    want[(9, n, 10 * 40_000 + 10, 3, hashlib.sha256(b"1,2,3").hexdigest(), True)] = 1
    for size in (1 << 20, 30):
        assert Counter(map(tuple, decontaminate.digests(decontaminate.contamination(odd, bench, block_bytes=size)).collect())) == want
    assert decontaminate.contamination(none, bench).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(odd, empty).filter("contaminated or n_items > 0 or n_hit > 0").count() == 0


# --- operator 13


def brute_audit(rows, min_docs=10, top=10):
    """rows: lang, source, text."""
    rows = [tuple(x or "" for x in r) for r in rows]
    own, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))
        own[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = [s for x, s in own if x == lang]
        total = Counter()
        for s in sources:
            total.update(own[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept)
            return [1 + (10**9 * (c[t] + 2)) // (n + 2 * len(kept)) for t in kept]

        p, q = {s: shares(own[lang, s]) for s in sources}, shares(total)
        f = lambda a, b: math.floor(Fraction((a - b) ** 2, a + b))
        for s in sources:
            far = sorted(((-sum(map(f, p[s], p[o])), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(far)]
            most = sorted((-f(a, b), t.encode(), t) for t, a, b in zip(kept, p[s], q) if own[lang, s][t] and a > b)
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(most[:top])]
    return sorted(out)


def invented(seed, n_docs, n_sources, size=300):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(size)]
    rows = []
    for _ in range(n_docs):
        source = rng.randint(0, n_sources - 1)
        lang = rng.choice(["en", "fr"])
        rows.append((lang, f"s{source}", " ".join(rng.choice(vocabulary[source % 7 * 5 :]) if rng.random() < 0.7 else vocabulary[source % 11] for _ in range(rng.randint(0, 40))).title()))
    return rows


@pytest.mark.parametrize("n_sources,block,steps,growth", [(3, 256, 8, 4), (40, 6, 8, 4), (12, 4, 1, 2)])
def test_audit(spark, monkeypatch, n_sources, block, steps, growth):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "STEPS", steps)
    monkeypatch.setattr(divergence, "GROWTH", growth)
    rows = invented(n_sources, 400, n_sources, 150)
    rows += [("xx", "rare", "seen once"), ("xx", "other", None), ("en", None, "é é"), (None, None, None), (None, "z", "only null language"), ("en", "silent", "12 34")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    top = 3 if block == 4 else 10
    assert sorted(map(tuple, divergence.audit(docs, top=top).collect())) == brute_audit(rows, top=top)


def test_audit_stops_early_and_right(spark, monkeypatch):
    """Waves are left out where their bounds are below the k-th value, and the result is that of all terms."""
    rows = [("en", f"s{k % 4}", " ".join([f"own{k % 4}x"] * 50 + ["".join(random.Random(j * 7 + k % 4).choices("abcdefgh", k=3)) for j in range(100)])) for k in range(200)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    staged = []
    monkeypatch.setattr(divergence, "stage", lambda df, name, f=divergence.stage: staged.append(name) or f(df, name))
    got = sorted(map(tuple, divergence.audit(docs, top=1).collect()))
    assert got == brute_audit(rows, top=1)
    assert staged.count("top-terms") == 1  # of several waves
    # all terms of one share: only ties, by name
    rows = [("en", s, " ".join(f"t{a}{b}" for a in "abcde" for b in "abcdé")) for s in "xy" for _ in range(10)] + [("en", "y", "taa")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, divergence.audit(docs).collect())) == brute_audit(rows)


def test_audit_of_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 1000)
    monkeypatch.setattr(divergence, "HELD", 3)
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert sorted(map(tuple, divergence.audit(odd, min_docs=2).collect())) == brute_audit(rows, min_docs=2)
    assert divergence.audit(none).count() == 0


def test_slices_hold_whole_terms():
    text = b" ".join(random.Random(1).choices([b"a", b"bcd", b"x" * 50], k=500))
    for size in (1, 7, 60, 10_000):
        divergence.SLICE, was = size, divergence.SLICE
        try:
            assert b" ".join(divergence._slices(text)).split() == text.split()
        finally:
            divergence.SLICE = was


# --- operator 11


def brute_negatives(rows, every=100, positives=5, negatives=10):
    """rows: vec_id, embedding, label; rows are told apart by their place."""
    own = []
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        own.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * v) for v in x]))
    out = []
    for k, (a, y, x) in enumerate(own):
        if a % every:
            continue
        met = sorted((-sum(map(int.__mul__, x, z)), i, n, label) for n, (i, label, z) in enumerate(own) if n != k and len(z) == len(x))
        for s, i, _, _ in [r for r in met if r[3] == y][:positives]:
            some = [r for r in met if r[3] != y and 30 * -s <= 100 * -r[0] <= 90 * -s][:negatives]
            out += [(a, i, rank + 1, r[1], -s, -r[0]) for rank, r in enumerate(some)]
    return Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def clustered(seed, n, dims):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(8)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        scale = rng.choice([0.2, 0.5, 1])
        rows.append((i, [scale * (v + rng.gauss(0, 0.15)) for v in c], rng.randint(0, 9)))
    return rows


@pytest.mark.parametrize("cell,group,block", [(2500, 512, 4096), (40, 8, 50), (100, 3, 20)])
def test_hard_negatives(spark, cell, group, block):
    rng = random.Random(cell)
    rows = [(i, None if x is None else [rng.choice([v, v, round(v, 1)]) for v in x], y) for i, x, y in clustered(cell, 500, 6)]
    rows += [(500 + k, rows[3][1], 4) for k in range(40)] + [(600 + k, rows[100][1], 1) for k in range(20)]  # copies
    rows = [(i, [struct_float(v) for v in x], y) for i, x, y in rows]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(4), every=20, cell=cell, group=group, block=block).collect()
    assert Counter(map(tuple, got)) == brute_negatives(rows, every=20) and len(got) > 300


def struct_float(v):
    import struct

    return struct.unpack("f", struct.pack("f", v))[0]


def test_hard_negatives_prune(spark):
    """The ranges leave rows of far cells out, and results stay whole."""
    rows = [(i, [struct_float(v) for v in x], y) for i, x, y in clustered(9, 800, 3)]
    own = hard_negatives.Pivots.ranges
    df = spark.createDataFrame(rows, VECTORS)
    got = hard_negatives.mine(df, every=50, cell=25, group=4, block=64).collect()
    assert Counter(map(tuple, got)) == brute_negatives(rows, every=50)
    # the ranges themselves: narrower than everything
    import numpy as np
    import pandas as pd

    p = hard_negatives.Pivots()
    vecs = [np.floor(256 * np.array(x)).astype("<i4").tobytes() for _, x, _ in rows]
    norm = [float((hard_negatives._matrix([v])[0].astype(float) ** 2).sum()) for v in vecs]
    p.add(3, sorted(set(vecs[::40])), max(norm))
    far = p.distances(3, vecs, False)
    s = hard_negatives.scores(hard_negatives._matrix(vecs[:1]), hard_negatives._matrix(vecs))[0]
    low = float(sorted(s)[-10])
    at = own(p, pd.DataFrame({"g": ["x"], "dims": [3], "vec": vecs[:1], "norm": norm[:1], "low": [low], "high": [math.inf]}))
    home = far.argmin(1)
    inside = np.array([at.least[h] <= far[k, h] <= at.most[h] for k, h in enumerate(home)])
    assert inside[s >= low].all() and inside.mean() < 0.9


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (7, [1.0, 0.5], 0), (7, [1.0, 0.5], 0), (100, [0.5, 0.5], 1), (100, [0.5, 0.5], 1), (3, [0.25, 0.25], 2), (4, [0.25, 0.25], 2), (4, [0.25, 0.25], 2), (None, [1.0, 1.0], 2),
            (5, None, 1), (6, [1.0, None], 1), (8, [nan, 1.0], 2), (9, [inf, 0.0], 2), (10, [1.0, 2.0], None), (11, [], 1), (200, [], 2), (12, [0.0, 0.0], 3), (300, [1.0, 0.0, 0.0], 1), (13, [1.0, 0.0, 0.0], 1), (14, [0.5, 0.0, 0.0], 2), (-100, [0.5, 0.25], 1)]
    df = spark.createDataFrame(rows, VECTORS + "").selectExpr("*", "'x' as cell", "1L as row", "2 as g", "3 as score", "4 as block")
    want = brute_negatives(rows)
    assert Counter(map(tuple, hard_negatives.mine(df).collect())) == want and want
    assert Counter(map(tuple, hard_negatives.mine(df, cell=2, group=1, block=2).collect())) == want
    assert hard_negatives.mine(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [3e38, 1.0], 1), (1, [1e5, -1e5], 1), (2, [1e5, 3e4], 2), (100, [1e5, 1e5], 1)], VECTORS)
    got = hard_negatives.mine(huge).collect()
    assert {r.positive_id for r in got} <= {1} and all(r.anchor_id == 100 for r in got)


def test_hard_negatives_on_given_vectors(spark):
    df = table(spark, SF, "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = brute_negatives(rows, every=10)
    assert Counter(map(tuple, hard_negatives.mine(df, every=10, cell=50, group=8, block=100).collect())) == want
