"""Operator 12: passages of benchmark items found in documents by Wu-Manber multi-pattern search.

A benchmark item's windows (``width`` words in a row; all its words, if it has fewer) are the patterns.  Texts are brought
to one form first, " word word word ", so that a pattern found in its bytes is found at whole words.  Patterns of
similar length make one set.  Of a set's shortest length m, a table of hashed blocks says how far a block's last place can
be from the end of any pattern's first m bytes: a search place moves on by that much unread.  Where it is 0, the hash
of the m bytes' suffix and first block selects a bucket of patterns, and bytes are compared.  A batch's texts lie side by side,
cut into stretches whose search places move together as numpy arrays.

Tables are broadcast for ``block_bytes`` of benchmark text at a time.  A benchmark of several blocks is searched for block
by block, and what was found is put together by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, lean, rows_per_group, small_batches, stage

#: Words of a window; bytes of benchmark text whose tables are broadcast at once; words of a long item's piece.
WIDTH, BLOCK_BYTES, PIECE_WORDS = 10, 1 << 20, 8192
#: Patterns of these many bytes or more, up to the next number, make one set.
LENGTHS = (3, 8, 16, 32)

#: Bytes of words stay (A-Z as a-z), all others are spaces.
_FORM = np.full(256, 32, np.uint8)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _FORM[_a:_b] = np.arange(_a, _b)
_FORM[0x41:0x5B] = np.arange(0x61, 0x7B)
_FORM_BYTES = _FORM.tobytes()
_K = np.uint64(0x9E3779B97F4A7C15)


def _words(text: bytes) -> list[bytes]:
    return text.translate(_FORM_BYTES).split()


def _loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place (a view; the last seven places have none)."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))


class Side:
    """Texts side by side in one form: `` word word \\n`` each."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" " + b" \n ".join(texts) + b" \n", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 3) - 1
        form = _FORM[raw]
        form[ends] = 10
        space = form == 32
        space[1:] &= space[:-1].copy()
        space[0] = False
        form = form[~space]
        self.n = len(form)
        self.end = np.flatnonzero(form == 10)
        self.spaces = np.flatnonzero(form == 32)
        self.first = np.concatenate([[0], self.end[:-1] + 1]).astype(np.int64)
        self.first_space = np.searchsorted(self.spaces, self.first)
        self.n_words = np.searchsorted(self.spaces, self.end) - self.first_space - 1
        self.form = np.concatenate([form, np.zeros(8, np.uint8)])


class PatternSet:
    """Wu-Manber's tables for patterns of at least ``m`` bytes."""

    def __init__(self, patterns: list[bytes], ids: list[int]):
        m = self.m = min(map(len, patterns))
        b = self.block = m if m < 8 else 4 if m < 16 else 8
        heads = np.frombuffer(b"".join(p[:m] for p in patterns) + b"\0" * 8, np.uint8)
        at = _loads(heads)
        first = np.arange(len(patterns), dtype=np.int64) * m
        self.bits = max(12, min(24, (2 * len(patterns) * (m - b + 1)).bit_length()))
        self.shift = np.full(1 << self.bits, m - b + 1, np.int32)
        for k in range(m - b + 1):  # the last one has the least shift
            np.minimum.at(self.shift, self._hash(at[first + k]), m - b - k)
        keys = self._keys(at, first)
        order = np.argsort(keys, kind="stable")
        self.keys, self.patterns, self.ids = keys[order], [patterns[k] for k in order], np.array(ids, np.int64)[order]

    def _hash(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks << np.uint64(8 * (8 - self.block))) * _K >> np.uint64(64 - self.bits)).astype(np.int64)

    def _keys(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Hash of the first block and the suffix of the ``m`` bytes from each place."""
        if self.m < 8:
            return (at[first] << np.uint64(8 * (8 - self.m))) * _K
        x = at[first] * _K
        for k in range(self.m - 8, max(0, self.m - 25), -8):
            x = (x ^ (x >> np.uint64(29)) ^ at[first + k]) * _K
        return x

    def found(self, side: Side) -> tuple[np.ndarray, np.ndarray]:
        """Places and pattern ids of all occurrences."""
        at, most = _loads(side.form), self.m - self.block + 1
        stretch = 64 * most
        p = np.arange(self.m - 1, side.n, stretch)
        stop = np.minimum(p + stretch, side.n)
        hits = []
        while len(p):
            step = self.shift[self._hash(at[p - self.block + 1])]
            hits.append(p[step == 0] - self.m + 1)
            p = p + np.maximum(step, 1)
            live = p < stop
            p, stop = p[live], stop[live]
        first = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        keys = self._keys(at, first)
        a, b = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        places, ids = [], []
        for k in np.flatnonzero(b > a).tolist():
            s = int(first[k])
            for j in range(int(a[k]), int(b[k])):
                p = self.patterns[j]
                if side.form[s : s + len(p)].tobytes() == p:
                    places.append(s)
                    ids.append(self.ids[j])
        return np.array(places, np.int64), np.array(ids, np.int64)


class Patterns:
    """The windows of item texts, each once, with the items that have it."""

    def __init__(self, rows: list[tuple[str, bytes]], width: int):
        known: dict[bytes, int] = {}
        owners: list[set[str]] = []
        sizes: list[int] = []
        for item, text in rows:
            words = text.split()
            for k in range(max(1, len(words) - width + 1)):
                window = words[k : k + width]
                i = known.setdefault(b" " + b" ".join(window) + b" ", len(known))
                if i == len(owners):
                    owners.append(set())
                    sizes.append(len(window))
                owners[i].add(item)
        self.owners, self.sizes = [sorted(x) for x in owners], np.array(sizes, np.int64)
        by: dict[int, tuple[list[bytes], list[int]]] = {}
        for p, i in known.items():
            own = by.setdefault(sum(len(p) >= x for x in LENGTHS), ([], []))
            own[0].append(p)
            own[1].append(i)
        self.sets = [PatternSet(*x) for x in by.values()]

    def search(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """Number of words, runs of hit words (first, past the last) and items of each text."""
        side = Side(texts)
        both = [s.found(side) for s in self.sets]
        places = np.concatenate([x[0] for x in both] or [np.zeros(0, np.int64)])
        ids = np.concatenate([x[1] for x in both] or [np.zeros(0, np.int64)])
        doc = np.searchsorted(side.first, places, "right") - 1
        word = np.searchsorted(side.spaces, places) - side.first_space[doc]
        runs: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for k in np.lexsort((word, doc)).tolist():
            d, a, i = int(doc[k]), int(word[k]), int(ids[k])
            b, own = a + int(self.sizes[i]), runs[d]
            if own and a <= own[-1][1]:
                own[-1] = (own[-1][0], max(b, own[-1][1]))
            else:
                own.append((a, b))
            items[d].update(self.owners[i])
        return side.n_words, runs, [sorted(x) for x in items]


def _pieces(width: int):
    """item, words: an item's words, long items in pieces that share ``width - 1`` words with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words = _words(text)
                for k in range(0, max(1, len(words) - width + 1) if words else 0, PIECE_WORDS):
                    items.append(item)
                    texts.append(b" ".join(words[k : k + PIECE_WORDS + width - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.binary())], names=["item", "words"])

    return run


_RUN = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _found(sent, only_hits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, items = sent.value.search(batch.column("text").cast(pa.binary()).to_pylist())
            out = pa.RecordBatch.from_pydict({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_words": pa.array(n), "runs": pa.array([[{"a": a, "b": b} for a, b in x] for x in runs], _RUN), "items": pa.array(items, pa.list_(pa.string()))})
            yield out.filter(pa.array([bool(x) for x in runs], pa.bool_())) if only_hits else out

    return lean(run)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of several blocks as runs that do not touch."""
    for batch in batches:
        out = []
        for runs in batch.column("runs").to_pylist():
            own: list[dict[str, int]] = []
            for x in sorted(runs, key=lambda x: x["a"]):
                if own and x["a"] <= own[-1]["b"]:
                    own[-1]["b"] = max(own[-1]["b"], x["b"])
                else:
                    own.append(x)
            out.append(own)
        yield batch.set_column(batch.schema.get_field_index("runs"), "runs", pa.array(out, _RUN))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, runs, contaminated: one row a row of ``docs``.

    ``runs`` are the runs of hit words (first, past the last), ``items`` the sorted ids, as strings, of the items found.  A null or
    empty text has no words and no hits; items without words have no windows.  Rows of one id each have a result; item
    rows of one id are one item, those without an id one item named ''.  Texts of any length are searched whole.  Without
    items nothing is hit; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    pieces = stage(own.mapInArrow(_pieces(width), "item string, words binary"), "benchmark")
    blocks = rows_per_group(pieces.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0], block_bytes)
    of = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    texts = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), texts)
    if blocks > 1:
        rows = keyed(docs, "doc_id", "text").select("row", F.col("doc_id").cast("long").alias("doc_id"), texts)
    found = None
    for k in range(blocks):
        sent = spark.sparkContext.broadcast(Patterns([(r.item, bytes(r.words)) for r in pieces.filter(of == k).collect()], width))
        part = rows.mapInArrow(_found(sent, k > 0), "row long, doc_id long, n_words long, runs array<struct<a: long, b: long>>, items array<string>")
        if blocks > 1:
            part = stage(part, "hits")
            sent.destroy()
        found = part if found is None else found.union(part)
    if blocks > 1:
        found = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = found.select("doc_id", "n_words", "runs", "items").mapInArrow(_merged, "doc_id long, n_words long, runs array<struct<a: long, b: long>>, items array<string>")
    n_hit = F.expr("aggregate(runs, 0L, (s, x) -> s + x.b - x.a)")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "runs", (F.size("runs") > 0).alias("contaminated"))


def digests(found: DataFrame) -> DataFrame:
    """``contamination`` with the items as a digest."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
