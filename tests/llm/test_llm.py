"""Training-data operators against brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from graphloom.llm import bpe, common, components, importance, linear, lm_score, metric_join, minhash, packing, quality_rules, sharding, token_store, toxicity
from graphloom.llm.common import new_path, table
from graphloom.llm.encode import PieceEncoder

SF = "/root/testdata/sf0.001"
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One two three."), (4, "One two three."), (5, "one  two\nthree."), (6, "x" * 5000), (7, "é " * 3000), (None, "no id")]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, start long, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 5 else "s", "en", 1, 0, "k") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def strange(n=1500):
    rng = random.Random(1)
    letters = ".;:²½Ⅷ5_ \t\n\r\x0b\x1c\x85\xa0 　ab'sé1,<|endoftext|>Σσ́!"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["a <|endoftext|> b<|endoftext|>", "x<|startoftext|>  \n y", "  ", "", "ab" * 500]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_encode_as_whole_texts(path):
    texts = [*strange(), "\n".join(strange(300)) * 30, "é" * 70 + " " + "ab" * 40]
    whole = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    own = PieceEncoder(path, max_pieces=500).encode(texts)
    assert [np.array(e.ids, "<u4").tobytes() for e in whole] == own
    # the same with a cache that is emptied and refilled, and with long texts cut where a piece begins
    enc = PieceEncoder(path, max_pieces=200, max_piece_bytes=9)
    assert [x for k in range(0, len(texts), 50) for x in enc.encode(texts[k : k + 50])] == own
    column = pa.array(texts).cast(pa.large_string())
    ids, n = enc.encode_flat(np.frombuffer(column.buffers()[2], np.uint8), np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1], at_once=100)
    assert ids.tobytes() == b"".join(own) and n.tolist() == [len(x) // 4 for x in own]


def test_segment_tree_bpe_is_the_library(docs):
    texts = strange() + ["".join(random.Random(k).choices("abcdethinré", k=k)) for k in range(1, 90)]
    t, c = Tokenizer.from_file(BYTE), bpe.Codec(BYTE, max_known=2000)
    ids = c.encode_batch(texts)
    assert ids == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [c.decode(x) for x in ids] == [t.decode(x, skip_special_tokens=False) for x in ids]
    assert list(c.merge(("ab" * 200).encode())) == t.encode("ab" * 200).ids
    d = docs.limit(20)
    assert {(r.doc_id, r.text) for r in bpe.decode_ids(bpe.encode_ids(d, BYTE), BYTE).collect()} == {(r.doc_id, r.text) for r in d.collect()}


def test_round_trip_digests(odd, none):
    t = Tokenizer.from_file(BYTE)
    want = Counter((i, len(ids := t.encode(x or "").ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()) for i, x in ODD)
    assert Counter(map(tuple, bpe.round_trip(odd, BYTE).collect())) == want
    assert bpe.round_trip(none, BYTE).count() == 0


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_token_store(request, spark, which):
    df = request.getfixturevalue(which)
    path = new_path(spark, "store")
    token_store.write_store(df, path, BYTE, run_rows=60)
    got = sorted((tuple(r) for r in token_store.read_digests(spark, path).collect()), key=lambda r: r[1])
    t, at, want = Tokenizer.from_file(BYTE), 0, []
    for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array([*t.encode(r.text or "").ids, 2], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [r[:4] for r in got] == want and all(r[5] for r in got)
    if which == "docs":
        chunks = spark.read.parquet(f"{path}/objects").filter("kind = 'chunk'")
        assert chunks.count() == chunks.select("key").distinct().count()
        assert token_store.read_ids(spark, path, [3])[3] == [*t.encode(df.filter("doc_id = 3").first().text).ids, 2]
    x = np.frombuffer(random.Random(3).randbytes(40_000), "<u4")
    y = np.concatenate([x[:500], x])
    cut = lambda v: token_store.cut(0, len(v), token_store.marks(v).tolist())
    ends = lambda v: {v[a:b].tobytes() for a, b in zip([0, *cut(v)], cut(v))}
    assert len(ends(x) & ends(y)) > 0.7 * len(ends(x))  # a shift leaves most chunks as they are


def test_token_store_manifest(spark, docs):
    """Recipes that are changed whole or lost are noticed, though every recipe agrees with its own root."""
    path = new_path(spark, "store")
    token_store.write_store(docs, path, BYTE, run_rows=60)
    assert token_store.verify_manifest(spark, path).filter("agrees").count() == token_store.verify_manifest(spark, path).count() > 2
    recipes = spark.createDataFrame(spark.read.parquet(f"{path}/recipes").collect(), spark.read.parquet(f"{path}/recipes").schema)
    least = recipes.agg({"part": "min"}).first()[0]
    some = recipes.filter(recipes.part > least).filter("doc_id <> 150")
    some.write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="no recipes are left of 1 runs"):
        token_store.read_digests(spark, path)
    recipes.filter("doc_id <> 150").write.mode("overwrite").parquet(f"{path}/recipes")
    got = token_store.read_digests(spark, path).collect()
    part = {r.doc_id: r.part for r in recipes.collect()}
    assert all(r.whole == (part[r.doc_id] != part[150]) for r in got) and any(r.whole for r in got)


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + d for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(docs, labels, odd, none):
    texts = [r.text for r in docs.collect()] + [t or "" for _, t in ODD] + strange(300) + ["a b c a b c", "x\ny\nx\n \n"]
    assert [quality_rules.base_counts(t) for t in texts] == [brute_counts(t) for t in texts]
    # the verdict on labels that fitting has not seen
    half = labels.filter("pmod(xxhash64(doc_id), 2) = 0")
    unseen = quality_rules.quality(docs, half).withColumnRenamed("quality", "p").join(labels.join(half, "doc_id", "left_anti"), "doc_id").toPandas()
    assert unseen[unseen.quality == 1].query("not base_failed").kept.mean() > 0.9 and unseen[unseen.quality == 0].kept.mean() < 0.35
    got = quality_rules.quality(docs, labels).withColumnRenamed("quality", "p").join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].query("not base_failed").kept.mean() > 0.97
    assert got[got.quality == 0].kept.mean() < 0.3
    assert quality_rules.quality(odd, labels).count() == len(ODD) and quality_rules.quality(none, labels).count() == 0


def test_linear_scores_are_the_vectors():
    texts = [t.encode() for t in strange(50)]
    w = np.random.default_rng(1).normal(size=4 << 6).astype(np.float32)
    assert np.allclose(linear.vectors(texts, 6) @ w + 0.5, linear.linear_scores(texts, w, 0.5, 6), atol=1e-4)
    assert np.array_equal(linear.linear_scores(texts[7:8], w, 0.5, 6), linear.linear_scores(texts, w, 0.5, 6)[7:8])


def test_stupid_backoff(spark, odd, none):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("a b c d e The the".split()) for _ in range(rng.randint(0, 9)))) for k in range(40)] + [(99, "a b"), (99, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = [t.lower().split() for _, t in rows]
    one, two, n = Counter(w for x in words for w in x), Counter(p for x in words for p in zip(x, x[1:])), sum(map(len, words))
    want = []
    for (i, _), x in zip(rows, words):
        o1, o2, s, missed = Counter(x), Counter(zip(x, x[1:])), 0.0, 0
        for k, w in enumerate(x):
            c2 = two[x[k - 1], w] - o2[x[k - 1], w] if k else 0
            if c2:
                s += np.log(c2 / (one[x[k - 1]] - o1[x[k - 1]]))
            else:
                missed += 1
                c1 = one[w] - o1[w]
                s += np.log((0.4 * c1 if c1 else 0.16) / max(n - len(x), 1))
        want.append((i, len(x), missed, round(s, 6)))
    got = [(r.doc_id, r.n_words, r.n_backoff, round(r.log_score, 6)) for r in lm_score.scores(df, block_bytes=60, table_ngrams=40).collect()]
    assert sorted(got) == sorted(want)
    # order 3 and 1 by the definition: the longest n-gram that others have, ALPHA for each level below the order
    grams = [Counter(g for x in words for g in zip(*(x[k:] for k in range(m)))) for m in (1, 2, 3)]
    for order in (1, 3):
        want = []
        for (i, _), x in zip(rows, words):
            own = [Counter(zip(*(x[k:] for k in range(m)))) for m in (1, 2, 3)]
            rest = lambda g: grams[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: E731, B023
            s, missed = 0.0, 0
            for k in range(len(x)):
                for m in range(order, 0, -1):
                    g = tuple(x[k - m + 1 : k + 1])
                    if k - m + 1 >= 0 and rest(g) > 0:
                        s += np.log(0.4 ** (order - m) * rest(g) / (rest(g[:-1]) if m > 1 else max(n - len(x), 1)))
                        missed += m < order
                        break
                else:
                    s, missed = s + np.log(0.4**order / max(n - len(x), 1)), missed + 1
            want.append((i, len(x), missed, round(s, 6)))
        got = [(r.doc_id, r.n_words, r.n_backoff, round(r.log_score, 6)) for r in lm_score.scores(df, order, block_bytes=60, table_ngrams=40).collect()]
        assert sorted(got) == sorted(want)
    assert lm_score.scores(odd).count() == len(ODD) and lm_score.scores(none).count() == 0


def test_importance_resampling(spark, docs, labels, odd, none):
    d, lab = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    big = importance.resample(d, lab).join(lab, "doc_id").toPandas()
    assert big[big.quality == 1].sampled.mean() > 0.98 and big[big.quality == 0].sampled.mean() < 0.5
    got = importance.resample(docs, labels).join(labels, "doc_id", "left").toPandas()
    assert len(got) == docs.count()
    assert got[got.quality == 0].mean_log_weight.mean() < got[got.quality == 1].mean_log_weight.mean()
    for k in (0, 1, 25, 10**6):
        drawn = importance.resample(docs, labels, k=k).filter("sampled").toPandas()
        assert sorted(drawn.gumbel_key) == sorted(got.gumbel_key)[::-1][:k][::-1]
    assert importance.resample(odd, labels).count() == len(ODD) and importance.resample(none, labels).count() == 0
    assert importance.resample(odd, labels, k=5).filter("sampled").count() == 5
    plain = importance.resample(odd, labels.limit(0), carry=("text", "key", "doc_id", "source"))
    assert plain.filter("sampled").count() == len(ODD) and {"key", "text", "source"} <= set(plain.columns)
    assert Counter(r.text for r in plain.collect()) == Counter(t for _, t in ODD)


def test_importance_weights_by_definition(docs, labels):
    """Log weights and their means, recomputed with Counters of n-grams that plain Python finds."""
    got = {r.doc_id: r for r in importance.resample(docs, labels).collect()}
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    sample = [t.encode() for t, y in linear.labelled(docs, labels, "quality", importance.MAX_FIT, importance.MAX_FIT_BYTES) if y == 1]
    of: tuple[dict, dict, dict] = ({}, {}, {})  # an n-gram's cell, which must be one

    def grams(raw):
        words = raw.split()  # at ASCII white space
        return words, [*zip(words, words[1:]), *((w,) for w in words[-1:])], [(raw + b"\0" * 4)[k : k + 4] for k in range(len(raw))]

    def cells(raw):
        t = importance.Texts([raw], lower=False)
        out = []
        for kind, (own, (f, x, y)) in enumerate(zip(grams(raw), importance._items(t))):
            cell = np.asarray(f)[x[0] : y[0]].tolist()
            assert len(cell) == len(own) and all(of[kind].setdefault(g, c) == c for g, c in zip(own, cell))
            out.append(Counter(cell))
        return out

    add = lambda parts: [sum((p[k] for p in parts), Counter()) for k in range(3)]
    raw, target = add([cells(t) for t in texts.values()]), add([cells(t) for t in sample])
    size = 1 << importance.BITS
    assert all(len(set(x.values())) > 0.5 * min(len(x), size) for x in of)  # n-grams are spread over the cells
    for i, t in texts.items():
        w = n = 0
        for k, c in enumerate(cells(t)):
            whole = [sum(x[k].values()) + size for x in (target, raw)]
            for cell, m in c.items():
                w, n = w + m * np.log((target[k][cell] + 1) / whole[0] * whole[1] / (raw[k][cell] + 1)), n + m
        assert got[i].n_grams == n and abs(got[i].log_weight - w) < 1e-3 * max(1, abs(w))
        assert (got[i].mean_log_weight is None) == (n == 0)


def test_importance_draws_in_proportion_to_weights(spark, docs, labels):
    """Over many seeds, rows are drawn as often as sampling without replacement by exp(SPAN * mean) draws them: neither a
    threshold nor the k largest weights."""
    seeds, k = range(300), 90
    scored, _, _ = importance.weighed(docs, labels)
    pdf = scored.filter("n_grams > 0").select("_id", "mean_log_weight", *(importance.gumbel_key(s).alias(f"k{s}") for s in seeds)).toPandas()
    weight = np.exp(importance.SPAN * pdf.mean_log_weight.to_numpy())
    drawn = np.zeros(len(pdf))
    overlap = []
    top = set(np.argsort(-weight, kind="stable")[:k].tolist())
    for s in seeds:
        own = np.argsort(-pdf[f"k{s}"].to_numpy())[:k]
        drawn[own] += 1
        overlap.append(len(top & set(own.tolist())) / k)
    # one row after another, in proportion to what is left
    rng, want = np.random.default_rng(5), np.zeros(len(pdf))
    for _ in range(2000):
        want[rng.choice(len(pdf), k, replace=False, p=weight / weight.sum())] += 1
    gap = np.abs(drawn / len(seeds) - want / 2000)
    assert gap.max() < 0.15 and gap.mean() < 0.03
    assert 0.5 < np.mean(overlap) < 0.9 and 0.1 < (drawn > 0).mean() and ((drawn > 0) & (drawn < len(seeds))).mean() > 0.5
    for s in (0, 3):
        ids = {r.doc_id for r in importance.resample(docs, labels, seed=s, k=k).filter("sampled").collect()}
        assert ids == set(pdf.sort_values(f"k{s}", ascending=False)._id[:k])


def test_first_rows_breaks_ties(spark):
    keys = spark.range(20_001).selectExpr("1.0D AS x", "id % 7 AS t", "id AS p")
    assert keys.filter(importance.first_rows(keys, ("x", "t", "p"), 15_000)).count() == 15_000
    rng = random.Random(3)
    rows = [(rng.choice([0.5, -1.25, 1e300]), rng.choice([-(2**62), 2**62, 2**62 + 1, 5]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "x double, t long, p long")
    for k in (1, 77, 250, 499, 500):
        assert sorted(map(tuple, df.filter(importance.first_rows(df, ("x", "t", "p"), k)).collect())) == sorted(rows)[:k]


def brute_groups(rows, width):
    sets, u = {}, components.UnionFind()
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*(w[k:] for k in range(width)))) if len(w) >= width else {tuple(w)} if w else set()
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                u.union(a, b)
    return {i: (len(sets[i]), u.find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, width):
    rng = random.Random(2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(200)]
    for k in range(60):  # copies that are all near one text and not all near one another
        x = list(base)
        for _ in range(4):
            x[rng.randrange(200)] = f"w{k}{rng.random()}"
        rows.append((10_000 + k, " ".join(x)))
    rows += [(20_000, " ".join(base)), (30_000, None), (30_001, ""), (30_002, "Hi"), (30_003, "hi")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows, width)
    assert all(r.kept == r.first == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    """A result a row: rows of one id and rows without one are compared by their own texts."""
    base = " ".join(f"w{k}" for k in range(300))
    rows = [(1, base), (1, "quite another text of seven words here"), (2, base + " more"), (None, base), (None, "Hi there"), (None, "hi there"), (None, "alone")]
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, row string, component_id int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept, r.first) for r in minhash.near_duplicates(df, 2).collect())
    assert got == Counter([(1, 299, 1, True, True), (1, 6, 1, True, True), (2, 300, 1, False, False), (None, 299, 1, False, False), (None, 1, None, True, True), (None, 1, None, False, False), (None, 1, None, True, True)])
    got = minhash.near_duplicates(odd, 2).collect()
    assert len(got) == len(ODD) and sum(r.first for r in got) == len(ODD) - 2
    assert Counter((r.doc_id, r.n_shingles) for r in got)[2, 0] == 1 and sum(r.kept for r in got if r.doc_id == 4) == 2
    assert minhash.near_duplicates(none, 2).count() == 0
    long = " ".join(f"w{k % 70_000}" for k in range(400_000))  # megabytes of text
    two = spark.createDataFrame([(5, long), (9, long.upper()), (7, long[: len(long) // 2])], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(two, 5).collect()} == {i: c for i, (_, c) in brute_groups([(r.doc_id, r.text) for r in two.collect()], 5).items()}


def test_super_minhash_estimates():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a, b = pool[:200], pool[100:]
    s = minhash.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], 200), 2, 1000)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.06
    # one element's registers are a permutation of ranks
    one = minhash.super_minhash(pool[:1], np.zeros(1, int), 1, 64)
    assert sorted((one[0] >> np.uint64(32)).tolist()) == list(range(64))


def test_components(spark, none):
    rng = random.Random(3)
    e = [(rng.randint(0, 900), rng.randint(0, 900)) for _ in range(400)] + [(5, k) for k in range(1000, 1300)] + [(k, k + 1) for k in range(2000, 2100)]
    u = components.UnionFind()
    for a, b in e:
        u.union(a, b)
    for size in (100, 10**9):
        got = {r.node: r.component for r in components.components(spark.createDataFrame(e, "a long, b long"), part_links=size).collect()}
        assert all(got.get(x, x) == u.find(x) for x in list(u.parent))


def test_toxicity(spark, docs, labels, odd, none):
    d, lab = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")  # enough labels to learn from
    m = toxicity.train(d, lab)
    got = toxicity.score(d, m).join(lab, "doc_id").toPandas()
    out = got[got.held_out]
    hit = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert hit / (out.toxic == 1).sum() > 0.82 and hit / (out.predicted == 1).sum() > 0.9
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(got.doc_id, got.held_out))
    assert got.score.between(0, 1).all()
    found = toxicity.offending_sentences(d.filter("doc_id < 400"), m).limit(50).collect()
    texts = {r.doc_id: r.text.encode() for r in d.filter("doc_id < 400").collect()}
    assert found and all(texts[r.doc_id][r.start : r.end].decode("utf-8", "replace") == r.sentence for r in found)
    assert toxicity.score(odd, m).count() == len(ODD) and toxicity.score(none, m).count() == 0 and toxicity.score(odd, None).count() == len(ODD)


def test_toxicity_scores_by_definition(docs, labels):
    """Scores, verdicts and the worst sentence from a scorer that splits with re and sums an n-gram at a time."""
    import re

    m = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, m).collect()}
    cell: dict = {}  # (kind, n-gram): the weights' place, from the operator's own hash of that n-gram alone

    def weight(kind, gram):
        if (kind, gram) not in cell:
            t = toxicity.Texts([gram], lower=True)
            places, f = toxicity._items(t)[kind]
            cell[kind, gram] = float(m.weights[f[np.searchsorted(places, t.start[0])]])
        return cell[kind, gram]

    for r in docs.orderBy("doc_id").limit(60).collect():
        raw = r.text.encode()
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
        ends = sorted({x.end() for x in re.finditer(rb"[.!?]+(?=\s)|\n", raw)} | {len(raw)})
        z = []
        for a, b in zip([0, *ends], ends):
            total = m.bias + sum(weight(0, low[x.start() : x.end()]) for x in re.finditer(rb"[^ \t-\r\0]+", low) if a <= x.start() < b)
            for kind, n in ((1, 4), (2, 5), (3, 6)):
                total += sum(weight(kind, low[k : k + n]) for k in range(a, b))
            z.append((total, -a, b))
        best = max(z)
        own = got[r.doc_id]
        p = 1 / (1 + np.exp(-best[0]))
        assert abs(own.score - p) < 1e-4 and own.predicted == int(own.score >= toxicity.THRESHOLD) and own.n_sentences == len(z)
        if sorted(z)[-2:][0][0] < best[0] - 1e-3 or len(z) == 1:
            assert (own.worst_start, own.worst_end) == (-best[1], best[2])


def test_toxicity_of_long_texts(spark, docs, labels):
    m = toxicity.train(docs, labels)
    got = toxicity.score(docs, m).filter("score < 0.05").join(labels.filter("toxic = 0"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").orderBy("doc_id").limit(60).select("text", "score").collect()
    long = spark.createDataFrame([(k, "\n".join([r.text for r in got] * k)) for k in (1, 5, 40)], "doc_id long, text string")
    assert len(got) > 20 and all(r.score <= max(x.score for x in got) + 1e-9 for r in toxicity.score(long, m).collect())
    # texts of all lengths are drawn; only those that no longer fit into the bytes of all are passed over
    d = spark.createDataFrame([(k, "x " * 10_000 if k < 4 else "y") for k in range(8)], "doc_id long, text string")
    lab = d.select("doc_id", (d.doc_id % 2).cast("int").alias("toxic"))
    assert sum(len(t) for t, _ in linear.labelled(d, lab, "toxic", 10, 1 << 20)) == 4 * 20_001
    assert sorted(len(t) for t, _ in linear.labelled(d, lab, "toxic", 10, 25_000)) == [1] * 4 + [20_000] * 2


def test_metric_join(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[:100] + rng.normal(size=(100, 8)) * 0.15
    x[200:230] = x[5]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, []), (904, [1.0, None] + [0.0] * 6), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cell, block = metric_join.CELL, metric_join.BLOCK
    metric_join.CELL, metric_join.BLOCK = 20, 16
    try:
        got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.range_links(df).collect()}
    finally:
        metric_join.CELL, metric_join.BLOCK = cell, block
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    find = components.UnionFind()
    for a, b in zip(*np.nonzero(near)):
        find.union(int(a), int(b))
    want = {k: (int(near[k].sum()), find.find(k)) for k in range(300)} | {k: (0, k) for k in range(900, 906)}
    assert got == want
    assert metric_join.range_links(df.limit(0)).count() == 0


def test_metric_join_copies_no_vectors(spark):
    """Random vectors can reach every cell: what is staged stays within a few times the vectors, and the links are those of all pairs."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x[1500:1700] = x[:200] + rng.normal(size=(200, 64)).astype(np.float32) * 0.2
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<float>")
    cell, block, before = metric_join.CELL, metric_join.BLOCK, len(common._made)
    metric_join.CELL, metric_join.BLOCK = 100, 150
    try:
        got = {r.vec_id: r.n_links for r in metric_join.range_links(df).collect()}
    finally:
        metric_join.CELL, metric_join.BLOCK = cell, block
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert got == dict(enumerate(((u @ u.T >= 0.95).sum(1) - 1).tolist())) and sum(got.values()) >= 300
    assert sum(f.stat().st_size for path in common._made[before:] for f in Path(path).rglob("*.parquet")) < 4 * x.nbytes


def test_metric_join_of_odd_ids(spark):
    """Rows of one id and rows without an id each have a result; other columns may have any names."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.99, 0.01, 0.0]
    rows = [(1, a), (1, b), (2, c), (None, a), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 2.0]), (3, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<double>, rep string, row long")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in metric_join.range_links(df).collect())
    assert got == Counter([(1, 2, 1, True), (1, 0, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 1, None, True), (None, 1, None, False), (3, 0, 3, True)])


@pytest.mark.parametrize("cell_rows", [15, 10_000])
def test_sharding(docs, odd, none, cell_rows):
    got = sharding.interleave(docs, cell_rows=cell_rows).toPandas()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(got.doc_id) == sorted(text)
    assert all(s == len(text[i].encode()) + 1 and c == zlib.crc32(text[i].encode()) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32))
    sizes = got.groupby("shard").size()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    per = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (per.max(axis=1) - per.min(axis=1)).max() <= 2
    # the order itself: seeded shuffle within each source, then the fractional rank, cut into equal parts
    mixed = lambda i: (hashlib.md5(f"mix:{i}".encode()).hexdigest(), i)
    order = []
    for _, g in got.groupby("source"):
        ids = sorted(g.doc_id, key=mixed)
        order += [((2 * r + 1) / (2 * len(ids)), *mixed(i)) for r, i in enumerate(ids)]
    order, n = [i for *_, i in sorted(order)], len(got)
    assert {i: (s, t) for i, s, t in zip(got.doc_id, got.shard, got.slot)} == {i: (8 * g // n, g - -(-(8 * g // n) * n // 8)) for g, i in enumerate(order)}
    assert sharding.interleave(odd).count() == len(ODD) and sharding.interleave(none).count() == 0


def test_sharding_of_rows_without_ids(spark):
    """Rows without ids and of one text are spread over cells, and the law holds for them, too; a text of megabytes counts whole."""
    rows = [(None, "same", "a") for _ in range(90)] + [(7, "same", "c") for _ in range(20)] + [(k, "é" * 10, None) for k in range(30)] + [(99, "x" * 3_000_000, "b")]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), cell_rows=5).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(rows) and sizes.max() - sizes.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert sorted(got["size"]) == sorted(len(t.encode()) + 1 for _, t, _ in rows) and got[got.doc_id.isna()].groupby("shard").size().max() <= 90 // 8 + 2


def test_packing(docs, odd, none):
    t = Tokenizer.from_file(WORD)
    for df in (docs, odd):
        got = packing.pack(df, WORD).toPandas()
        want = Counter()
        for r in df.collect():
            ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
            want.update((r.doc_id if r.doc_id is not None else -1, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096))
        assert Counter(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.length, got.ids_crc32)) == want
        for _, g in got.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
        assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1
    assert packing.pack(none, WORD).count() == 0


def test_bin_completion():
    rng = random.Random(7)
    for n in (1, 12, 40):
        lengths = [rng.randint(20, 90) for _ in range(n)]
        bins = packing.bin_completion(np.bincount(lengths, minlength=101), 100)
        assert sorted(sum(bins, [])) == sorted(lengths) and all(sum(b) <= 100 for b in bins)
        assert len(bins) <= len(packing.best_fit(np.bincount(lengths, minlength=101), 100))
    # best fit decreasing needs 3 bins here, the best packing 2
    assert len(packing.bin_completion(np.bincount([6, 5, 3, 2, 2, 2], minlength=11), 10)) == 2


def fewest_bins(lengths, capacity):
    """By trying every place for every piece, largest first, and giving up where a packing is no better than the best one."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for left in set(bins):
            if left >= lengths[k]:
                i = bins.index(left)
                place(k + 1, [*bins[:i], left - lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_bin_completion_is_the_best_packing():
    rng = random.Random(11)
    better = 0
    for _ in range(200):
        capacity = rng.choice([10, 17, 30, 60])
        lengths = [rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(max(1, capacity // 6), capacity // 2 + 1) for _ in range(rng.randint(1, 11))]
        counts = np.bincount(lengths, minlength=capacity + 1)
        bins, first = packing.bin_completion(counts, capacity), packing.best_fit(counts, capacity)
        assert sorted(sum(bins, [])) == sorted(lengths) and all(sum(b) <= capacity for b in bins)
        assert len(bins) == fewest_bins(lengths, capacity) >= packing.lower_bound(counts, capacity)
        better += len(bins) < len(first)
    assert better > 0  # best fit alone is not enough


def test_bins_of_many_pieces():
    # the best packing has bins of six pieces and more; best fit needs a bin more
    for lengths, capacity, best in (([900, 800, 700, 650] * 1000, 4096, 760), ([16, 2, 6, 8, 9, 14, 5, 6, 16, 9, 4, 10, 5, 10, 6, 4, 5, 6, 15, 8, 16, 7, 8, 6, 2, 30, 6, 1], 60, 4)):
        counts = np.bincount(lengths, minlength=capacity + 1)
        bins = packing.bin_completion(counts, capacity)
        assert Counter(x for b in bins for x in b) == Counter(lengths) and all(sum(b) <= capacity for b in bins)
        assert len(bins) <= best and packing.lower_bound(counts, capacity) <= len(bins)
    # all undominated fillings of 30 by brute force are among those found
    rng = random.Random(5)
    for _ in range(20):
        counts = np.bincount([rng.randint(2, 12) for _ in range(9)], minlength=31)
        found, more = packing.fillings(counts, 30, 1000)
        pieces = [x for x in range(31) for _ in range(counts[x])]
        every = {tuple(sorted((x for k, x in enumerate(pieces) if m >> k & 1), reverse=True)) for m in range(1 << len(pieces))}
        every = {f for f in every if sum(f) <= 30}
        assert not more and set(found) <= every and all(any(packing._within(f, g) for g in found) for f in every)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    one = p.quality(spark, docs, SF)
    two = p.toxic(spark, one, SF)
    three = p.near_duplicates(spark, two, SF)
    assert one.columns == two.columns == three.columns == list(p.COLUMNS)
    a, b, c = ({r.doc_id for r in x.select("doc_id").collect()} for x in (one, two, three))
    assert c < a and c <= b <= a
    rows = [(r.doc_id, r.text) for r in two.collect()]
    assert c == {i for i, (_, comp) in brute_groups(rows, 5).items() if i == comp}
    last = p.run(spark, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == c


def test_pipeline_rows_without_ids_and_repeated_rows(spark, docs, labels):
    import corpus_pipeline as p

    rows = docs.select(*p.COLUMNS)
    one = rows.join(labels.filter("quality = 1 and toxic = 0"), "doc_id", "left_semi").orderBy("doc_id").limit(30).collect()
    bad = rows.join(labels.filter("toxic = 1"), "doc_id", "left_semi").orderBy("doc_id").limit(20).collect()
    make = lambda x: spark.createDataFrame(x, rows.schema)
    texts = lambda df: Counter(r.text for r in df.collect())
    # rows without ids fare as the same rows with ids
    good, none = make(one), make([(None, *r[1:]) for r in one])
    assert len(one) == 30 and texts(p.toxic(spark, none, SF)) == texts(p.toxic(spark, good, SF)) and p.quality(spark, none, SF).count() > 20
    assert texts(p.near_duplicates(spark, none, SF)) == texts(p.near_duplicates(spark, good, SF))
    # one of repeated rows is left, one with an id where there is one
    left = p.near_duplicates(spark, make([(None, *r[1:]) for r in one] + one + one), SF).collect()
    assert Counter(r.text for r in left) == texts(p.near_duplicates(spark, good, SF)) and all(r.doc_id is not None for r in left)
    # a clean row does not bring back a toxic one of its id, and both texts are compared
    mixed = make([(r.doc_id, *b[1:]) for r, b in zip(one, bad)] + one)
    m = toxicity.train(mixed, table(spark, SF, "labels"))
    want = Counter(r.text for r in toxicity.score(mixed, m, carry=("text",)).filter("predicted = 0").collect())
    assert texts(p.toxic(spark, mixed, SF)) == want
    two = make([(7, *r[1:]) for r in one])
    assert texts(p.near_duplicates(spark, two, SF)) == texts(p.near_duplicates(spark, good, SF))


def test_pipeline_of_odd_and_no_rows(spark, docs):
    """Every stage takes an empty table, null and very long texts, null columns, repeated rows and other columns."""
    import corpus_pipeline as p

    none = docs.select(*p.COLUMNS).limit(0)
    for name, f in p.STAGES:
        assert f(spark, none, SF).count() == 0, name
    long = " ".join(f"word{k % 900}" for k in range(60_000))
    rows = [(1, None, None, None, None), (None, None, "en", "s", 0), (2, "", "en", "s", 0), (3, long, "en", None, 1), (3, long, "en", None, 1), (4, long.replace("word7 ", "other ", 1), "en", "s", 1), (None, "Hi", "en", "s", 2)]
    odd = spark.createDataFrame([(*r, "x", 7) for r in rows], docs.select(*p.COLUMNS).schema.simpleString()[7:-1].replace(":", " ") + ", row string, path int")
    assert p.quality(spark, odd, SF).columns == p.toxic(spark, odd, SF).columns == list(p.COLUMNS)
    assert Counter(map(tuple, p.toxic(spark, odd, SF).collect())) <= Counter(rows)
    left = Counter((r.doc_id, r.text) for r in p.near_duplicates(spark, odd, SF).collect())
    assert left == Counter([(1, None), (None, None), (2, ""), (3, long), (None, "Hi")])
    assert p.packed(spark, odd, SF).filter("piece = 0").count() == len(rows)


def test_batches_are_bounded(spark):
    from graphloom.llm.common import BATCH_BYTES, small_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for asked, got in (("64m", f"{BATCH_BYTES}b"), ("16m", f"{BATCH_BYTES}b"), ("2m", "2m")):
        spark.conf.set(name, asked)
        small_batches(spark)
        assert spark.conf.get(name) == got
    spark.conf.unset(name)


def test_signatures_in_parts():
    """Signatures of parts of the elements, merged, equal those of all at once; empty sets anywhere."""
    rng, sizes = np.random.default_rng(3), np.array([0, 900, 2, 0, 130, 1, 0])
    elements, owner = rng.integers(0, 2**63, sizes.sum()).astype(np.uint64), np.repeat(np.arange(7), sizes)
    want = minhash.super_minhash(elements, owner, 7)
    for at_once in (50, 131, 4096):
        assert (minhash.signatures(elements, owner, 7, at_once) == want).all()


def test_joining_in_blocks():
    """A cell's links join the groups that brute force joins: within a block, and across two blocks."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.08, 0.3]), rng.integers(0, 2**62, 60).astype(np.uint64), base)) for _ in range(60)]
    linked = {(a, b) for a in range(60) for b in range(a) if minhash.MOST * len(np.intersect1d(sets[a], sets[b])) >= minhash.LEAST * len(np.union1d(sets[a], sets[b]))}
    for sides in ([0] * 60, [k % 2 for k in range(60)]):
        wanted, got = components.UnionFind(), components.UnionFind()
        for a, b in linked:
            if 1 not in sides or sides[a] != sides[b]:
                wanted.union(a, b)
        found = list(minhash._joining(list(range(60)), list(range(60)), sides, sets))
        for a, b in found:
            assert (max(a, b), min(a, b)) in linked
            got.union(a, b)
        assert [got.find(k) for k in range(60)] == [wanted.find(k) for k in range(60)]
        assert len(found) < 60
