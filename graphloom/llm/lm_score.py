"""Operator 4: stupid-backoff language-model scores over the corpus itself.

Words are runs without white space (or NUL), A-Z lower-cased.  With order 2, each word after the first is scored by its pair
with the word before it, count(pair) / count(word before); if no other document has the pair, by ALPHA * count(word) /
words; if none has the word either, by ALPHA^2 / words.  Higher orders begin with longer n-grams, ALPHA for each level
they back off.  The first words of a text start at the level they have words for.  All counts leave
the scored document out, so that a document does not vouch for itself; all documents count.

Relationally: n-grams are exploded, grouped by document block (``block_bytes`` of text), and dealt by hash to count
tables; each table adds up its n-grams over all blocks and is joined back to the blocks that hold them, where documents
sum their scores.  A row holds the n-grams of one block that fall into one table, as a sorted array of 64-bit hashes; no
row is without n-grams, so there are never more rows than n-grams of blocks.  A block has a frequent n-gram once, however
many documents hold it, so none is a large group.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lean, rows_per_group, stage
from .hashed import Texts, groups, mix

ALPHA, ORDER = 0.4, 2
BLOCK_BYTES, TABLE_NGRAMS = 6 << 20, 3_000_000


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, texts, held, k
            body = struct.pack(f"<{len(texts)}q", *map(len, texts)) + b"".join(texts)
            raw = zstandard.ZstdCompressor(level=3).compress(body)
            out = pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([len(words_of(texts)[0])], pa.int64()), pa.array([raw], pa.binary())], names=["block", "ids", "n_words", "body"])
            ids, texts, held, k = [], [], 0, k + 1
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode()
                if texts and held + len(raw) > block_bytes:
                    yield flush()
                ids.append(doc_id)
                texts.append(raw)
                held += len(raw)
        if texts:
            yield flush()

    return run


def _texts(ids: list[int], body: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = len(ids)
    at, out = 8 * n, []
    for size in struct.unpack(f"<{n}q", raw[: 8 * n]):
        out.append(raw[at : at + size])
        at += size
    return out


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' words one after another, and where each text's begin and end; about 1 MB of text is worked on at a time."""
    hashes, first, last, n = [np.zeros(0, np.uint64)], [], [], 0
    for a, b in groups(texts):
        t = Texts(texts[a:b], lower=True)
        s, _, h = t.words()
        x, y = t.spans(s)
        hashes.append(h)
        first.append(x + n)
        last.append(y + n)
        n += len(h)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(hashes), np.concatenate(first or none), np.concatenate(last or none)


class Block:
    """A block's n-grams: ``keys`` are the distinct hashes; ``at[k]`` indexes them for the (k + 1)-gram that begins at each
    word, and ``real[k]`` tells where the text goes on for so long."""

    def __init__(self, texts: list[bytes], order: int):
        h, self.first, self.last = words_of(texts)
        left = np.repeat(self.last, self.last - self.first) - np.arange(len(h))  # words from here to the text's end
        gram, grams, self.real = h, [mix(h ^ np.uint64(0x5851F42D4C957F2D))], [np.ones(len(h), bool)]
        for k in range(1, order):
            after = np.zeros(len(h), np.uint64)
            after[: max(len(h) - k, 0)] = h[k:]
            gram = mix(gram * np.uint64(2 * k + 1) + after * np.uint64(0xD6E8FEB86659FD93))
            grams.append(gram)
            self.real.append(left > k)
        used = np.concatenate([g[r] for g, r in zip(grams, self.real)])
        self.keys, at = np.unique(used, return_inverse=True)
        self.counted = np.bincount(at, minlength=len(self.keys))
        ends = np.cumsum([int(r.sum()) for r in self.real])
        self.at = []
        for r, a, b in zip(self.real, [0, *ends], ends):
            index = np.zeros(len(h), np.int64)
            index[r] = at[a:b]
            self.at.append(index)


def _edges(keys: np.ndarray, tables: int) -> np.ndarray:
    """Where each table's keys begin in sorted keys: tables are equal ranges of the hash."""
    limits = np.array([(k << 64) // tables for k in range(1, tables)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Differences of sorted keys and the counts, as byte planes (equal bytes side by side compress)."""
    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return struct.pack("<q", len(keys)) + step.view(np.uint8).reshape(-1, 8).T.tobytes() + zlib.compress(counts.astype("<u4").tobytes(), 1)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<q", raw)[0]
    planes = np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n)
    keys = np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64))
    return keys.astype(np.uint64), np.frombuffer(zlib.decompress(raw[8 + 8 * n :]), "<u4")


def _requests(tables: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, body in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), batch.column("body").to_pylist()):
                b = Block(_texts(ids, body), order)
                edge = _edges(b.keys, tables)
                some = np.flatnonzero(np.diff(edge))  # tables that hold n-grams of the block: never more rows than n-grams
                packed = [_pack(b.keys[edge[k] : edge[k + 1]], b.counted[edge[k] : edge[k + 1]]) for k in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([block] * len(some), pa.int64()), pa.array(packed, pa.binary())], names=["tab", "block", "grams"])

    return run


def _add_up(key: tuple, group: pa.Table) -> pa.Table:
    """A count table: totals of its n-grams, given back to each block in the block's order."""
    sizes, keys, counts = [], [], []
    for raw in group.column("grams"):
        k, c = _unpack(raw.as_buffer())
        sizes.append(len(k))
        keys.append(k)
        counts.append(c)
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype("<i8")
    ends = np.cumsum(sizes)
    packed = [zlib.compress(total[at[e - n : e]].tobytes(), 1) for e, n in zip(ends, sizes)]
    return pa.table({"block": group.column("block"), "tab": pa.array([key[0].as_py()] * len(group), pa.int32()), "totals": pa.array(packed, pa.binary())})


def _own(index: np.ndarray, doc: np.ndarray, n_keys: int) -> np.ndarray:
    """How often each item's key occurs in its own document."""
    _, at, c = np.unique(doc * n_keys + index, return_inverse=True, return_counts=True)
    return c[at]


def block_scores(texts: list[bytes], totals: np.ndarray, n_words: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's words, backed-off words and summed natural logs."""
    b = Block(texts, order)
    sizes = b.last - b.first
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    n = len(doc)
    # counts[k][i]: how often other documents have the (k + 1)-gram that begins at word i
    counts = []
    for index, real in zip(b.at, b.real):
        c = np.zeros(n)
        c[real] = totals[index[real]] - _own(index[real], doc[real], len(b.keys))
        counts.append(c)
    value = np.full(n, ALPHA**order) / np.maximum(n_words - sizes[doc], 1)
    rest = np.maximum(n_words - sizes[doc], 1)
    value = np.where(counts[0] > 0, ALPHA ** (order - 1) * counts[0] / rest, value)
    hit = counts[0] > 0 if order == 1 else np.zeros(n, bool)
    for k in range(1, order):  # from pairs up: the longest n-gram that others have decides
        gram, before = counts[k][: max(n - k, 0)], counts[k - 1][: max(n - k, 0)]
        some = np.flatnonzero(gram > 0)
        value[some + k] = ALPHA ** (order - 1 - k) * gram[some] / np.maximum(before[some], 1)
        if k == order - 1:
            hit[some + k] = True
    total = np.concatenate([[0.0], np.cumsum(np.log(value))])
    missed = np.concatenate([[0], np.cumsum(~hit)])
    return sizes, missed[b.last] - missed[b.first], total[b.last] - total[b.first]


def scores(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, table_ngrams: int = TABLE_NGRAMS) -> DataFrame:
    """doc_id, n_words, n_backoff, log_score (sum), mean_log_score: one row a document.

    A null or empty text has no words, score 0 and a null mean; repeated rows count and score each; an empty table gives
    no rows.
    """
    blocks = stage(documents(docs).mapInArrow(lean(_blocks(block_bytes)), "block long, ids array<long>, n_words long, body binary"), "blocks")
    n_words = blocks.agg(F.sum("n_words")).first()[0] or 0
    tables = rows_per_group(order * n_words, table_ngrams)
    asked = blocks.select("block", "ids", "body").mapInArrow(lean(_requests(tables, order)), "tab int, block long, grams binary")
    told = stage(asked.groupBy("tab").applyInArrow(_add_up, "block long, tab int, totals binary"), "totals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, body, own in zip(batch.column("ids").to_pylist(), batch.column("body").to_pylist(), batch.column("told").to_pylist()):
                totals = np.concatenate([np.frombuffer(zlib.decompress(x["totals"]), "<i8") for x in sorted(own or [], key=lambda x: x["tab"])] or [np.zeros(0, np.int64)])  # none: a block without words
                n, missed, total = block_scores(_texts(ids, body), totals, n_words, order)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n.astype(np.int64)), pa.array(missed.astype(np.int64)), pa.array(total)], names=["doc_id", "n_words", "n_backoff", "log_score"])

    told = told.groupBy("block").agg(F.collect_list(F.struct("tab", "totals")).alias("told"))  # a block's own n-grams
    out = blocks.join(told, "block", "left").select("ids", "body", "told").mapInArrow(lean(run), "doc_id long, n_words long, n_backoff long, log_score double")
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
