"""Operator 11: hard negatives by an exact kNN join over a Voronoi partition.

Vectors become integers, x to floor(256 x).  A row gets one more component, sqrt(M^2 - |x|^2) with M the largest length, and an
anchor a zero: the nearer a row is to an anchor then, the larger is their inner product.  Rows and anchors are dealt to the
cell of their nearest pivot.  Anchors of near cells make groups of about ``group``.

A sample of each anchor's own cells gives a score that its result surely reaches, so a greatest distance (for negatives a least
one, too) at which a row can still count.  For a group and a pivot p the triangle inequality turns these into a range of
distances to p, and only rows of p's cell in that range are copied to the group.  A group meets the rows of a cell in blocks of
``block``, exactly, on integers; the first rows of all blocks are merged.

This is done twice: for positives (same label), then, as their scores say which negatives are allowed, for negatives.
Of equal vectors of one label the 11 smallest ids are candidates: no result can name more than 10 of them and the anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, stage, unstage

#: Rows to a pivot, anchors of a group, candidates of a block.
CELL, GROUP, BLOCK = 2500, 512, 4096
#: Pivots (sent to all tasks) of all vector lengths together, and the most lengths that have pivots; rows of the others are one cell.
MAX_PIVOTS, MAX_LENGTHS = 1024, 64
POSITIVES, NEGATIVES = 5, 10
#: Squared length from which on a score may not be a long.
LONGEST = float(1 << 62)

_ROWS = "row long, vec_id long, label long, dims int, vec binary, norm double"


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part, with their integers and squared length."""
    for batch in batches:
        at, flat = batch.column("embedding").offsets.to_numpy(), batch.column("embedding").values
        flat = np.floor(256 * flat.cast(pa.float64()).to_numpy(zero_copy_only=False))  # a null is not a number
        whole, dims, norms, raw = [], [], [], []
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            x = flat[a:b]
            if np.isfinite(x).all() and np.abs(x).max(initial=0) < 1 << 31 and (norm := float(x @ x)) < LONGEST:
                whole.append(k)
                dims.append(b - a)
                norms.append(norm)
                raw.append(x.astype("<i4").tobytes())
        own = batch.select(["row", "vec_id", "label"]).take(pa.array(whole, pa.int64()))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(norms, pa.float64())], names=["row", "vec_id", "label", "dims", "vec", "norm"])


def _matrix(vecs) -> np.ndarray:
    vecs = list(vecs)
    return np.frombuffer(b"".join(vecs), "<i4").reshape(len(vecs), -1) if vecs and vecs[0] else np.zeros((len(vecs), 0), "<i4")


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact."""
    most = float(a.shape[1]) * np.abs(a.astype(np.float64)).max(initial=0) * np.abs(b.astype(np.float64)).max(initial=0)
    kind = np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class Pivots:
    """Pivots of the common vector lengths: their number, coordinates, last component; and M squared."""

    def __init__(self):
        self.of: dict[int, tuple[int, np.ndarray, np.ndarray, float]] = {}
        self.n = 0

    def add(self, dims: int, vecs: list[bytes], longest: float) -> None:
        x = _matrix(vecs).astype(np.float64)
        more = np.sqrt(np.maximum(longest - (x * x).sum(1), 0))
        order, rest = [0], set(range(1, len(x)))
        while rest:  # neighbours get numbers in a row
            rest_at = np.array(sorted(rest))
            order.append(int(rest_at[((x[rest_at] - x[order[-1]]) ** 2).sum(1).argmin()]))
            rest.remove(order[-1])
        self.of[dims] = self.n, x[order], more[order], longest
        self.n += len(x)

    def distances(self, dims: int, vecs, anchors: bool) -> np.ndarray:
        """Of each row, or each anchor, to each pivot of its length."""
        _, p, more, longest = self.of[dims]
        x = _matrix(vecs).astype(np.float64)
        norm = (x * x).sum(1)
        square = longest + (norm if anchors else longest) - 2 * (x @ p.T).T
        if not anchors:
            square -= 2 * np.outer(more, np.sqrt(np.maximum(longest - norm, 0)))
        return np.sqrt(np.maximum(square, 0)).T

    def deal(self, anchors: bool):
        """cell and distance to its pivot of each row; rows of a length without pivots are the cell -1 - dims."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = np.array(batch.column("dims"))
                cell, far = -1 - dims.astype(np.int64), np.zeros(len(dims))
                for d in set(dims.tolist()) & set(self.of):
                    own = np.flatnonzero(dims == d)
                    for some in np.array_split(own, -(-len(own) // 2048)):
                        near = self.distances(d, batch.column("vec").take(pa.array(some)).to_pylist(), anchors)
                        cell[some] = self.of[d][0] + near.argmin(1)
                        far[some] = near.min(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

        return lean(run)

    def ranges(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """g, to, least, most: how far from its pivot a row of cell ``to`` can be that counts for one of the group's anchors.

        An anchor's rows have scores from ``low`` to ``high``.
        """
        d = int(pdf.dims.iloc[0])
        if d not in self.of:
            return pd.DataFrame({"g": [pdf.g.iloc[0]], "to": [-1 - d], "least": [-np.inf], "most": [np.inf]})
        first, p, _, longest = self.of[d]
        far = self.distances(d, pdf.vec, True)
        length = lambda s: np.sqrt(np.maximum(pdf.norm.to_numpy() + longest - 2 * s.to_numpy(), 0))[:, None]
        slack = 1e-6 * (np.sqrt(longest) + np.sqrt(pdf.norm.max())) + 1e-9
        outer, inner = length(pdf.low), length(pdf.high)
        least = np.maximum(far - outer, inner - far).min(0) - slack
        return pd.DataFrame({"g": pdf.g.iloc[0], "to": first + np.arange(len(p)), "least": least, "most": (far + outer).max(0) + slack})


def _positives(k: int):
    """anchor, id, at, score: the first ``k`` rows of the anchor's label in a block, the anchor itself left out."""

    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["vec_id", "row"])
        label, row, vec_id = (right[c].to_numpy() for c in ("label", "row", "vec_id"))
        out = [(np.zeros(0, np.int64),) * 4]
        if len(left) and len(right):
            s = scores(_matrix(left.vec), _matrix(right.vec))
            for i, (a, y) in enumerate(zip(left.row, left.label)):
                at = np.flatnonzero((label == y) & (row != a))
                at = at[np.argsort(-s[i, at], kind="stable")[:k]]
                out.append((np.full(len(at), a), vec_id[at], row[at], s[i, at]))
        return pd.DataFrame(dict(zip(("anchor", "id", "at", "score"), map(np.concatenate, zip(*out)))))

    return run


def allowed(positive: int, low: int, high: int) -> tuple[int, int]:
    """Scores s with low * positive <= 100 s <= high * positive: from, to."""
    return -(-low * positive // 100), high * positive // 100


def _negatives(k: int, low: int, high: int):
    """anchor, k, id, at, score: the first ``k`` rows of other labels in a block, for each of the anchor's positives."""

    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["vec_id", "row"])
        label, row, vec_id = (right[c].to_numpy() for c in ("label", "row", "vec_id"))
        out = [(np.zeros(0, np.int64),) * 5]
        if len(left) and len(right):
            s = scores(_matrix(left.vec), _matrix(right.vec))
            for i, (a, y, own) in enumerate(zip(left.row, left.label, left.positive_scores)):
                at = np.flatnonzero(label != y)
                at = at[np.argsort(-s[i, at], kind="stable")]
                down = -s[i, at]
                for j, positive in enumerate(own):
                    least, most = allowed(int(positive), low, high)
                    b, e = np.searchsorted(down, -most), np.searchsorted(down, -least, "right")
                    some = at[b : min(e, b + k)] if b < e else at[:0]
                    out.append((np.full(len(some), a), np.full(len(some), j + 1), vec_id[some], row[some], s[i, some]))
        return pd.DataFrame(dict(zip(("anchor", "k", "id", "at", "score"), map(np.concatenate, zip(*out)))))

    return run


def _meet(anchors: DataFrame, rows: DataFrame, where: DataFrame, run, kind: str) -> DataFrame:
    """``run`` on the anchors of each group and the rows of each block of each cell that ``where`` (g, to, least, most, blocks) names."""
    spread = F.explode(F.expr("sequence(0, blocks - 1)")).alias("block")
    left = anchors.join(where.select("g", "to", spread), "g")
    right = rows.join(where.withColumnRenamed("to", "cell"), "cell").filter("far between least and most")
    right = right.select("g", F.col("cell").alias("to"), F.expr("cast(pmod(xxhash64(row), blocks) as int)").alias("block"), "row", "vec_id", "label", "vec")
    key = ("g", "to", "block")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, kind)


def mine(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 30, high: int = 90, cell: int = CELL, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``; their positives are the first ``positives`` other rows of their
    label, the negatives of each are the first ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <=
    high * positive_score.  Rows with a null id, label or vector, or with a null or non-finite component take no part, nor do those so
    long (components times 256 with a squared length of 2^62 or more) that a score is no long.  Vectors of different lengths are not
    compared.  Ties go to the smaller vec_id.  Rows of one id each take part as a row of their own.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    own = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding").dropna()
    made = stage(own.select("row", "vec_id", label.alias("label"), "embedding").mapInArrow(lean(_integers), _ROWS), "integers")
    # equal rows of one label: the smallest ids are enough
    order = W.partitionBy("dims", "vec", "label").orderBy("vec_id", "row")
    rows = made.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max(positives, negatives) + 1).drop("r")
    lengths = made.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).filter(F.col("n") >= 2 * cell).orderBy(F.desc("n"), "dims").limit(MAX_LENGTHS).collect()
    pivots, total = Pivots(), sum(x.n for x in lengths)
    for x in lengths:
        k = max(1, min(MAX_PIVOTS * x.n // total, x.n // cell))
        chosen = made.filter(F.col("dims") == x.dims).orderBy(F.md5(F.col("row").cast("string")), "row").limit(k).collect()
        pivots.add(x.dims, sorted({bytes(c.vec) for c in chosen}), x.longest)
    dealt = _ROWS + ", cell long, far double"
    rows = stage(rows.mapInArrow(pivots.deal(False), dealt), "rows")
    anchors = made.filter(F.col("vec_id") % every == 0).mapInArrow(pivots.deal(True), dealt).drop("far")
    anchors = stage(anchors, "anchors")
    # groups: cells that follow one another until there are ``group`` anchors; a larger cell is split
    count = anchors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    named, base, held = [], 0, 0
    for x in sorted(count.filter("cell >= 0").collect()):  # at most MAX_PIVOTS
        if held and held + x.n > group:
            base, held = base + 1, 0
        named.append((x.cell, f"{base}", -(-x.n // group)))
        held += x.n
    own = count.filter("cell < 0").select("cell", F.col("cell").cast("string").alias("base"), F.ceil(F.col("n") / group).cast("int").alias("parts"))
    own = own.union(spark.createDataFrame(named, "cell long, base string, parts int"))
    g = F.concat_ws(":", "base", F.expr("pmod(xxhash64(row), parts)"), F.col("dims"))
    anchors = stage(anchors.join(own, "cell").withColumn("g", g).drop("base", "parts"), "groups")
    sizes = stage(rows.groupBy("cell").agg(F.min("far").alias("nearest"), F.max("far").alias("farthest"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).withColumnRenamed("cell", "to"), "sizes")
    # a sample of each cell: its first block
    sample = rows.join(sizes.withColumnRenamed("to", "cell"), "cell").filter("pmod(xxhash64(row), blocks) = 0").select(*rows.columns)
    near = stage(anchors.select("g", F.col("cell").alias("to"), F.lit(float("-inf")).alias("least"), F.lit(float("inf")).alias("most"), F.lit(1).alias("blocks")).distinct(), "near") if pivots.n else None

    def first(found: DataFrame, k: int, *key: str) -> DataFrame:
        at = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "id", "at"))
        return found.withColumn("rank", at).filter(F.col("rank") <= k)

    def where(needs: DataFrame) -> DataFrame:
        found = needs.select("g", "dims", "vec", "norm", "low", "high").groupBy("g").applyInPandas(lambda pdf: pivots.ranges(pdf), "g string, to long, least double, most double")
        return stage(found.join(sizes, "to").filter("least <= farthest and most >= nearest").select("g", "to", "least", "most", "blocks"), "reach")

    kind = "anchor long, id long, at long, score long"
    low_score = F.lit(float("-inf"))
    needs = anchors
    if pivots.n:
        kth = first(_meet(anchors, sample, near, _positives(positives), kind), positives, "anchor").filter(F.col("rank") == positives)
        needs = anchors.join(kth.select(F.col("anchor").alias("row"), "score"), "row", "left")
        low_score = F.coalesce(F.col("score").cast("double"), low_score)
    reach = where(needs.withColumn("low", low_score).withColumn("high", F.lit(float("inf"))))
    found = first(_meet(anchors, rows, reach, _positives(positives), kind), positives, "anchor")
    own = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("own"))
    anchors = anchors.join(own.withColumnRenamed("anchor", "row"), "row")
    anchors = stage(anchors.select(*anchors.columns[:-1], F.col("own.id").alias("positive_ids"), F.col("own.score").alias("positive_scores")), "positives")
    unstage(reach)

    kind = "anchor long, k int, id long, at long, score long"
    run = _negatives(negatives, low, high)
    at = anchors.select("g", "dims", "vec", "norm", "row", F.posexplode("positive_scores").alias("k", "positive"))
    least, most = F.expr(f"ceil({low}BD * positive / 100)").cast("double"), F.expr(f"floor({high}BD * positive / 100)").cast("double")
    at = at.select("g", "dims", "vec", "norm", "row", (F.col("k") + 1).alias("k"), least.alias("low"), most.alias("high")).filter("low <= high")
    if pivots.n:
        kth = first(_meet(anchors, sample, near, run, kind), negatives, "anchor", "k").filter(F.col("rank") == negatives)
        at = at.join(kth.select(F.col("anchor").alias("row"), "k", "score"), ["row", "k"], "left").withColumn("low", F.greatest("low", F.col("score").cast("double")))
    reach = where(at)
    found = first(_meet(anchors, rows, reach, run, kind), negatives, "anchor", "k")
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "positive_ids", "positive_scores")
    out = found.join(named, "anchor")
    return out.select("anchor_id", F.element_at("positive_ids", F.col("k")).alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.element_at("positive_scores", F.col("k")).alias("positive_score"), F.col("score").alias("negative_score"))
