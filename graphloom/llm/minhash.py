"""Operator 6: near-duplicates by SuperMinHash, banding, exact verification and union-find grouping.

Signature: each element of a document's shingle set draws a random permutation of the registers; its rank in the
permutation plus a random fraction competes for each register's minimum.  Ranks of one element are correlated (each
register a different one), which lowers the estimate's variance, and drawing stops once no rank can win any more.

Equal sets are grouped by a digest first; one of each, its representative, goes on.  Bands of ``ROWS`` registers
(``BANDS`` of them: a pair at the threshold is missed with probability (1 - 0.8^4)^28 < 1e-6) deal
representatives to buckets.  A bucket does not emit its pairs.  First its members are held against the member that is
in the most crowded buckets (``HUB_ROUNDS`` times, with another such member for those still apart), which joins large
groups of copies with one comparison a member.  Buckets whose members are still in different groups are then compared
whole: documents go to cells of about ``BLOCK`` shingles, a cell holds the full sets of its documents and
intersects them exactly, and only the links that join groups (a forest) leave it.  Buckets that share documents make
one set of cells where it has at most ``WHOLE`` blocks, so that a text travels once and not once a bucket; larger
ones are cut bucket by bucket, each block against each other one.  No pair of a bucket is left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, keyed, lean, stage, unstage
from .components import UnionFind, components, named
from .hashed import mix

ROWS, BANDS, HUB_ROUNDS = 4, 28, 2
REGISTERS = ROWS * BANDS
BLOCK, WHOLE = 1 << 18, 8
LEAST, MOST = 4, 5  # linked where MOST * intersection >= LEAST * union

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Words(dict):
    """64-bit values of words; bounded, and a word's value never depends on what else was seen."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= 300_000:
            self.clear()
        self[word] = value
        return value


_words = _Words()


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of the lower-cased (A-Z) text.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    w = min(width, len(h))
    x = np.full(len(h) - w + 1, w, np.uint64)
    for k in range(w):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - w + 1 + k])
    return np.unique(x)


def super_minhash(elements: np.ndarray, owner: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """(n_docs, registers) signatures of sets given as (element hash, owning set); empty sets keep the largest value."""
    worst = np.uint64(0xFFFFFFFFFFFFFFFF)
    table = np.full(n_docs * registers, worst, np.uint64)
    x, at = elements, owner
    swaps: list[np.ndarray] = []
    for j in range(registers):
        if not len(x):
            break
        draw = mix(x + np.uint64((2 * j + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(registers - j) >> np.uint64(32)).astype(np.int16)
        # the permutation's value at k: follow the earlier swaps back
        p = k.copy()
        for t in range(j - 1, -1, -1):
            np.putmask(p, p == swaps[t], t)
        swaps.append(k.astype(np.int16))
        np.minimum.at(table, at * registers + p, np.uint64(j) << np.uint64(32) | draw >> np.uint64(32))
        if j + 1 < registers:
            going = (table.reshape(n_docs, registers).max(1) >> np.uint64(32)) > j  # a later rank could still win
            keep = going[at]
            if not keep.all():
                x, at = x[keep], at[keep]
                swaps = [s[keep] for s in swaps]
    return table.reshape(n_docs, registers)


def signatures(elements: np.ndarray, owner: np.ndarray, n_docs: int, at_once: int = 1 << 18) -> np.ndarray:
    """``super_minhash`` in bounded memory: a signature is a minimum over elements, so parts of them merge exactly."""
    table = super_minhash(elements[:at_once], owner[:at_once], n_docs)
    for k in range(at_once, len(elements), at_once):
        part = owner[k : k + at_once]
        first = int(part[0])
        own = slice(first, int(part[-1]) + 1)
        np.minimum(table[own], super_minhash(elements[k : k + at_once], part - first, own.stop - first), out=table[own])
    return table


SKETCH = "doc_id long, own_id long, n_shingles long, same binary, bands array<long>"


def sketches(docs: DataFrame, width: int, own_id: str) -> DataFrame:
    """doc_id, own_id, n_shingles, same (digest of the set; null where empty), bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("own_id", pa.int64()), ("n_shingles", pa.int64()), ("same", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                sets = [shingles(t, width) for t in part.column("text").to_pylist()]
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                table = signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets))
                values = mix(table)
                key = np.zeros((len(sets), BANDS), np.uint64)
                for r in range(ROWS):
                    key = mix(key * np.uint64(31) + values[:, r::ROWS])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column(own_id), pa.array(sizes),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(list(key.view(np.int64)), pa.list_(pa.int64())),
                ], schema=schema)

    return documents(docs, own_id).mapInArrow(lean(run), SKETCH)


def _joining(ids: list[int], groups: list[int], sides: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Linked pairs of a cell that join two groups: of side 0 with side 1, or of all where there is no side 1."""
    local = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    own = lambda k: local[ends[k] - sizes[k] : ends[k]]
    if 1 in sides:
        asking, asked = ([k for k, s in enumerate(sides) if s == side] for side in (0, 1))
        if len(asking) > len(asked):
            asking, asked = asked, asking
    else:  # members of the largest group need not ask: they are linked already
        largest = max(Counter(groups).items(), key=lambda x: (x[1], -x[0]))[0]
        asking, asked = [k for k, g in enumerate(groups) if g != largest], list(range(len(ids)))
    if not asking or not asked:
        return
    asked = np.array(asked)[np.argsort(sizes[asked], kind="stable")]
    there, n = np.concatenate([own(k) for k in asked]), sizes[asked]
    begin = np.cumsum(n) - n
    mark, found = np.zeros(len(local), np.uint8), UnionFind()
    for q in asking:
        size = int(sizes[q])
        lo, hi = np.searchsorted(n, -(-LEAST * size // MOST)), np.searchsorted(n, MOST * size // LEAST, "right")
        if lo == hi:
            continue
        mark[own(q)] = 1
        both = np.add.reduceat(mark[there[begin[lo] : begin[hi - 1] + n[hi - 1]]], begin[lo:hi] - begin[lo], dtype=np.int64)
        mark[own(q)] = 0
        for k in asked[lo:hi][MOST * both >= LEAST * (size + n[lo:hi] - both)]:
            if found.find(groups[q]) != found.find(groups[k]):
                found.union(groups[q], groups[k])
                yield ids[q], ids[k]


def confirmed(cells: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """a, b: links on the full shingle sets that join groups, from cells (cell, i, j, side, doc_id, g)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, ([], [], [], [])

        def links() -> pa.RecordBatch:
            pairs = list(_joining(*members)) if len(members[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            for k in range(0, batch.num_rows, 64):  # few texts at a time as Python strings
                part = batch.slice(k, 64)
                for *cell, side, doc_id, g, text in zip(*(part.column(c).to_pylist() for c in ("cell", "i", "j", "side", "doc_id", "g", "text"))):
                    if cell != now:
                        yield links()
                        now, members = cell, ([], [], [], [])
                    for column, value in zip(members, (doc_id, g, side, shingles(text, width))):
                        column.append(value)
        yield links()

    rows = cells.join(texts, "doc_id").select("cell", "i", "j", "side", "doc_id", "g", "text")
    return rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side", "doc_id").mapInArrow(lean(run), "a long, b long")


def _blocks(sums: DataFrame) -> DataFrame:
    """cell, blocks: how many blocks a cell's ``shingles`` and ``members`` make."""
    return sums.select("cell", F.least(F.ceil(F.col("shingles") / BLOCK), F.col("members")).cast("int").alias("blocks"))


def _hub_cells(pairs: DataFrame) -> DataFrame:
    """Cells of one hub (side 0) and a block of its members (side 1), from pairs (hub, hub_g, doc_id, g, n)."""
    blocks = _blocks(pairs.groupBy(F.col("hub").alias("cell")).agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("members")))
    one = pairs.select(F.col("hub").alias("cell"), "hub_g").distinct().join(blocks, "cell")
    hubs = one.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.col("cell").alias("doc_id"), F.col("hub_g").alias("g"))
    members = pairs.withColumnRenamed("hub", "cell").join(blocks, "cell")
    return hubs.union(members.select("cell", F.expr("pmod(xxhash64(doc_id), blocks)").cast("int"), F.lit(0), F.lit(1), "doc_id", "g"))


def _bucket_cells(rows: DataFrame) -> DataFrame:
    """Cells of all pairs of the buckets in ``rows`` (bucket, doc_id, n, g): each block with itself and each other."""
    first = rows.groupBy("bucket").agg(F.min("doc_id").alias("least"))
    rows = rows.join(first, "bucket")
    around = components(rows.select("doc_id", "least"), "doc_id", "least").toDF("doc_id", "cell")
    docs = rows.select("doc_id", "n", "g").distinct().join(around, "doc_id")
    sums = (F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("members"))
    blocks = stage(_blocks(docs.groupBy("cell").agg(*sums)), "blocks")
    whole = docs.join(blocks.filter(F.col("blocks") <= WHOLE), "cell").select("cell", "blocks", "doc_id", "g")
    large = rows.join(docs.join(blocks.filter(F.col("blocks") > WHOLE), "cell").select("doc_id"), "doc_id").withColumnRenamed("bucket", "cell")
    large = large.join(_blocks(large.groupBy("cell").agg(*sums)), "cell").select("cell", "blocks", "doc_id", "g")
    placed = whole.union(large).withColumn("k", F.expr("pmod(xxhash64(doc_id), blocks)").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select("cell", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), (F.col("k") > F.col("other")).cast("int").alias("side"), "doc_id", "g")


def _with_groups(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """Rows of buckets whose members are in different groups, with each member's group ``g``."""
    if label is None:
        return rows.withColumn("g", F.col("doc_id"))
    rows = rows.join(label.toDF("doc_id", "g"), "doc_id", "left").withColumn("g", F.coalesce("g", "doc_id"))
    mixed = rows.groupBy("bucket").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).filter("g1 < g2")
    return rows.join(mixed, "bucket", "left_semi")


def _groups(made: DataFrame, docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame | None]:
    """same, rep of the distinct sets in ``made``, and the components of their representatives (None without links)."""
    same = stage(made.filter("same is not null").groupBy("same").agg(F.min("doc_id").alias("rep")), "same")
    reps = made.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    bands = reps.select("doc_id", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    bands = stage(bands.select("doc_id", "n", F.xxhash64("band", "key").alias("bucket")), "bands")
    crowds = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    crowded = bands.join(crowds, "bucket")
    crowd = crowded.groupBy("doc_id").agg(F.sum(F.log2("c")).alias("crowd"))
    rows = stage(crowded.select("doc_id", "n", "bucket").join(crowd, "doc_id"), "buckets")
    unstage(bands)
    # merged at every size: a broadcast of the smaller inputs' ids would only hide what the larger ones shuffle
    texts = documents(docs).join(rows.select("doc_id").distinct().hint("shuffle_merge"), "doc_id", "left_semi")
    texts = stage(texts, "texts")
    links = label = hubs = None
    for turn in range(HUB_ROUNDS + 1):
        open_rows = _with_groups(rows, label)
        if turn < HUB_ROUNDS:
            if hubs is not None:
                open_rows = open_rows.join(hubs, ["bucket", "doc_id"], "left_anti")
            # the hub of a bucket: its most crowded member that is no earlier hub there
            hub = open_rows.groupBy("bucket").agg(F.max(F.struct("crowd", (-F.col("doc_id")).alias("m"), F.col("n").alias("hub_n"), F.col("g").alias("hub_g"))).alias("h"))
            hub = hub.select("bucket", (-F.col("h.m")).alias("hub"), "h.hub_n", "h.hub_g")
            now = hub.select("bucket", F.col("hub").alias("doc_id"))
            hubs = stage(now if hubs is None else hubs.union(now), "hubs")
            pairs = open_rows.join(hub, "bucket").filter("g <> hub_g").filter(MOST * F.least("n", "hub_n") >= LEAST * F.greatest("n", "hub_n"))
            cells = _hub_cells(stage(pairs.select("hub", "hub_g", "doc_id", "g", "n").distinct(), "pairs"))
        else:
            cells = _bucket_cells(stage(open_rows.select("bucket", "doc_id", "n", "g"), "open"))
        found = stage(confirmed(cells, texts, width), "confirmed")
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        label = stage(components(links), "groups")
    unstage(texts, rows)
    return same, label


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept, first: one row a row of ``docs``; linked at a similarity of 0.8 or more.

    Rows are compared, whatever their ids: rows of one id, and rows without an id, each count with a text of their own.
    ``component_id`` is the smallest doc_id linked (null where no row of the component has an id), ``kept`` says that it is
    the row's own (null ids: that the row is the first of such a component), and ``first`` marks one row of each
    component, that of the smallest doc_id and place.  A null or empty text, or one without words, has an
    empty set, is linked with nothing and is kept.  An empty table gives no rows.
    """
    ids = keyed(docs, "doc_id", "text").select(F.col("row").alias("doc_id"), "text", F.col("doc_id").cast("long").alias("own_id"))
    made = stage(sketches(ids, width, "own_id"), "sketches")
    rep, component = _groups(made, ids, width)
    out = made.select("doc_id", "own_id", "n_shingles", "same").join(rep, "same", "left")
    out = out.join(component.toDF("rep", "c"), "rep", "left") if component is not None else out.withColumn("c", F.lit(None).cast("long"))
    out = named(out.withColumn("c", F.coalesce("c", "rep")), "c", "doc_id", "own_id")
    return out.select(F.col("doc_id").alias("row"), F.col("own_id").alias("doc_id"), "n_shingles", "component_id", "kept", "first")


def first_of_groups(docs: DataFrame, columns: tuple[str, ...], width: int = 5) -> DataFrame:
    """``columns`` of one row of each component (``first``); the places of the rows that go are what is shuffled beside the rows."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = stage(docs, "rows")
    gone = near_duplicates(docs, width).filter("NOT first").select("row")
    return keyed(docs, *columns).join(gone.hint("shuffle_merge"), "row", "left_anti").select(*columns)
