"""Operator 8: near-duplicate vectors by an exact metric range join.

On unit vectors, cosine >= c is a Euclidean distance of at most sqrt(2 - 2c).  Each vector lies in the cell of its nearest
pivot, and a cell is cut into blocks.  A vector can have a partner in another cell only where the triangle inequality puts it
within range of the bisector between its own pivot and that cell's, (|x - q|^2 - |x - p|^2) / (2 |p - q|) <= range.  A block
notes which cells its vectors can reach; each pair of blocks that reach one another is compared once, only the vectors that do,
in double precision (single precision, with a margin, finds what is worth it).  Blocks are read again for the pairs they are in
instead of being copied, so disk grows with the vectors and not with the pairs.  Equal vectors stand for one another.  A pair
of blocks emits a count of partners for each vector that has some, and a forest of links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, small_batches, stage
from .components import components, named

#: Vectors to a pivot, the most pivots (they are broadcast: MAX_PIVOTS vectors), and the most vector lengths that have pivots (vectors of
#: other lengths are one cell each); rows of a block, and the most bytes of its vectors as doubles; rows that are compared at a time.
CELL, MAX_PIVOTS, MAX_LENGTHS, BLOCK, BLOCK_BYTES, STRIP = 2500, 1024, 64, 4096, 4 << 20, 1024


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length, in doubles; a row's result does not depend on the others."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt(np.stack([(v * v).sum() for v in x]))[:, None]


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """length, rows, vectors (as they are stored) of those that can link: finite, without nulls, not zero."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.array(lists.offsets)
    values = lists.values.to_numpy(zero_copy_only=False)  # null components become nan
    sizes = np.where(np.array(lists.is_valid()), np.diff(ends), 0)
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        x = values[ends[at][:, None] + np.arange(d)]
        fit = np.isfinite(x).all(1) & (x != 0).any(1)
        if fit.any():
            yield d, at[fit], x[fit]


def _reached(x: np.ndarray, home: np.ndarray, pivots: np.ndarray, gaps: np.ndarray, reach: float) -> np.ndarray:
    """For each vector and cell, whether a partner of the vector can be there."""
    near = x @ pivots.T
    inside = near[np.arange(len(x)), home][:, None] - near <= reach * gaps[home] + 1e-9
    inside[np.arange(len(x)), home] = True
    return inside


def _gaps(pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-30))


def _place(pivots: dict[int, np.ndarray], whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """row, vec_id, dims, cell, same (null where the vector links with nothing), or row, dims, cell, same, vector of those that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            same: list[bytes | None] = [None] * batch.num_rows
            raw: list[bytes | None] = [None] * batch.num_rows
            for d, at, vectors in _by_length(batch.column("embedding")):
                units = _units(vectors)
                dims[at] = d
                if d in pivots:
                    cells[at] = (units @ pivots[d].T).argmax(1)
                for k, u, v in zip(at.tolist(), units, vectors):
                    same[k] = hashlib.blake2b((u + 0.0).tobytes(), digest_size=16).digest()  # + 0.0: no negative zeros
                    if whole:
                        raw[k] = v.tobytes()
            columns = {"row": batch.column("row"), "dims": pa.array(dims), "cell": pa.array(cells), "same": pa.array(same, pa.binary())}
            if whole:
                yield pa.RecordBatch.from_pydict(columns | {"vector": pa.array(raw, pa.binary())}).filter(columns["same"].is_valid())
            else:
                yield pa.RecordBatch.from_pydict(columns | {"vec_id": batch.column("vec_id")})

    return run


def _block(pivots: dict[int, np.ndarray], reach: float, kind: str):
    """One row for a block: its cell, rows, copies and vectors, and the cells that they can reach."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        d, cell = key[0].as_py(), key[1].as_py()
        raw = b"".join(group.column("vector").to_pylist())
        meets = np.ones(1, bool)
        if d in pivots:
            x = _units(np.frombuffer(raw, kind).reshape(-1, d))
            meets = _reached(x, np.full(len(x), cell), pivots[d], _gaps(pivots[d]), reach).any(0)
        ids, copies = (np.array(group.column(c), dtype="<i8").tobytes() for c in ("row", "copies"))
        one = {"dims": pa.array([d], pa.int32()), "cell": pa.array([cell], pa.int32()), "meets": pa.array([meets.tolist()], pa.list_(pa.bool_()))}
        return pa.table(one | {"ids": pa.array([ids], pa.binary()), "copies": pa.array([copies], pa.binary()), "vectors": pa.array([raw], pa.binary())})

    return run


def _links(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of at least that cosine."""
    slack = 1e-6 + 1.3e-7 * (x.shape[1] + 4)  # more than single precision can be off
    x4, y4 = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T)
    rows, cols = [], []
    for k in range(0, len(x), STRIP):
        r, c = np.divmod(np.flatnonzero(x4[k : k + STRIP] @ y4 >= least - slack), len(y))
        if len(r) > 4 * STRIP:  # many: all of the strip at once
            r, c = np.nonzero(x[k : k + STRIP] @ y.T >= least)
        elif len(r):
            true = np.einsum("ij,ij->i", x[k + r], y[c]) >= least
            r, c = r[true], c[true]
        rows.append(r + k)
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def _compare(pivots: dict[int, np.ndarray], least: float, reach: float, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """node, partners, low of pairs of blocks."""

    def side(row: dict, s: str, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors, ids and copies of what can reach the cell ``other``."""
        d, cell = row["dims"], row[f"cell{s}"]
        x = _units(np.frombuffer(row[f"vectors{s}"], kind).reshape(-1, d))
        ids, copies = np.frombuffer(row[f"ids{s}"], "<i8"), np.frombuffer(row[f"copies{s}"], "<i8")
        if cell == other:
            return x, ids, copies
        two = pivots[d][[cell, other]]
        take = _reached(x, np.zeros(len(x), np.int64), two, _gaps(two), reach)[:, 1]
        return x[take], ids[take], copies[take]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                x, xid, xn = side(row, "_a", row["cell_b"])
                itself = row["id_a"] == row["id_b"]
                y, yid, yn = (x, xid, xn) if itself else side(row, "_b", row["cell_a"])
                if not len(x) or not len(y):
                    continue
                r, c = _links(x, y, least)
                if itself:
                    r, c = r[r != c], c[r != c]
                if not len(r):
                    continue
                xlow = xid.copy()
                ylow = xlow if itself else yid.copy()
                while (xlow[r] != ylow[c]).any():  # smallest member along links, within the pair
                    np.minimum.at(xlow, r, ylow[c])
                    np.minimum.at(ylow, c, xlow[r])
                sides = [(xid, xlow, np.bincount(r, yn[c], len(x))), (yid, ylow, np.bincount(c, xn[r], len(y)))]
                for ids, low, n in sides[:1] if itself else sides:
                    met = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(n[met].astype(np.int64)), pa.array(low[met])], names=["node", "partners", "low"])

    return run


def _chosen(rows: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by vector length: rows drawn by their hash (any would do; they decide which blocks meet, not what is linked)."""
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= 2 * CELL) & (F.col("d") > 0)).orderBy(F.desc("n"), "d").limit(MAX_LENGTHS).collect()
    pivots = {}
    for r in lengths:
        k = max(1, min(MAX_PIVOTS * r.n // sum(x.n for x in lengths), r.n // CELL))
        drawn = rows.filter(F.size("embedding") == r.d).orderBy(F.xxhash64("row"), "row").limit(k).select("embedding").toArrow()
        fit = [_units(x) for _, _, x in _by_length(drawn.column("embedding"))]
        if fit:
            pivots[r.d] = np.unique(fit[0], axis=0)
    return pivots


def range_links(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vec_id``, ``embedding``.

    Vectors that are null, empty, zero or hold null or non-finite components have no links; vectors of different
    lengths never link.  Rows are compared whatever their ids: rows of one id, and rows without an id, each count and have a
    result of their own; a component without any id has a null ``component_id`` and its first row is kept.  An empty table
    gives no rows.
    """
    small_batches(vectors.sparkSession)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = keyed(vectors, "vec_id", "embedding").select("row", F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    reach = float(np.sqrt(2 - 2 * least))
    pivots = _chosen(rows)
    made = stage(rows.mapInArrow(_place(pivots, False), "row long, dims int, cell int, same binary, vec_id long").select("row", "vec_id", "dims", "cell", "same"), "vectors")
    fit = made.filter("same is not null")
    distinct = stage(fit.groupBy("same").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")), "distinct-vectors")
    # of equal vectors the first row goes into a block, with the number of them
    several = fit.select("row", "same").join(distinct.filter("copies > 1"), "same")
    several = stage(several.select("row", F.when(F.col("row") == F.col("rep"), F.col("copies")).otherwise(0).alias("n")), "copies")
    part_rows = F.greatest(F.least(F.lit(BLOCK), F.lit(BLOCK_BYTES) / (8 * F.col("dims"))), F.lit(1))
    sizes = fit.groupBy("dims", "cell").agg(F.approx_count_distinct("same").alias("n")).select("dims", "cell", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    dealt = rows.mapInArrow(_place(pivots, True), "row long, dims int, cell int, same binary, vector binary").join(stage(sizes, "cells"), ["dims", "cell"])
    dealt = dealt.select("row", "dims", "cell", F.pmod(F.xxhash64("same"), "parts").cast("int").alias("part"), "vector").join(several, "row", "left")
    dealt = dealt.withColumn("copies", F.coalesce("n", F.lit(1)).cast("long")).filter("copies > 0").drop("n")
    blocks = dealt.groupBy("dims", "cell", "part").applyInArrow(_block(pivots, reach, kind), "dims int, cell int, meets array<boolean>, ids binary, copies binary, vectors binary")
    blocks = stage(blocks.withColumn("id", F.monotonically_increasing_id()), "blocks")
    a, b = (blocks.select("dims", *(F.col(c).alias(c + s) for c in ("id", "cell", "meets", "ids", "copies", "vectors"))) for s in ("_a", "_b"))
    # each pair once, in whichever order; every task reads a part of the blocks for either side
    turn = (F.col("id_a") < F.col("id_b")) == (F.pmod(F.xxhash64("id_a").bitwiseXOR(F.xxhash64("id_b")), F.lit(2)) == 0)
    meet = F.get("meets_a", F.col("cell_b")) & F.get("meets_b", F.col("cell_a"))
    pairs = a.join(b.withColumnRenamed("dims", "dims_b").hint("shuffle_replicate_nl"), (F.col("dims") == F.col("dims_b")) & ((F.col("id_a") == F.col("id_b")) | ((F.col("id_a") != F.col("id_b")) & turn)) & meet)
    pairs = pairs.select("dims", *(c + s for s in ("_a", "_b") for c in ("id", "cell", "ids", "copies", "vectors")))
    found = stage(pairs.mapInArrow(_compare(pivots, least, reach, kind), "node long, partners long, low long"), "partners")
    partners = found.groupBy("node").agg(F.sum("partners").alias("partners"))
    groups = components(found.filter("node != low"), "node", "low")
    per = distinct.join(partners.toDF("rep", "partners"), "rep", "left").join(groups.toDF("rep", "component"), "rep", "left")
    out = made.select("row", "vec_id", "same").join(per, "same", "left").withColumn("c", F.coalesce("component", "rep"))
    out = out.withColumn("n_links", F.coalesce(F.col("partners") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)))
    return named(out, "c", "row", "vec_id").select("vec_id", "n_links", "component_id", "kept")
