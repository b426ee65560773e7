"""Connected components of link tables, by union-find in partitions and alternating stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_per_group, stage, unstage


class UnionFind:
    """Roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, path = self.parent, []
        while (p := parent.setdefault(x, x)) != x:
            path.append(x)
            x = p
        for y in path:
            parent[y] = x
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as stars around its smallest members."""
    found = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.union(a, b)
    nodes = [x for x in found.parent if found.find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([found.find(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b", part_links: int = 200_000) -> DataFrame:
    """node, component (its smallest member) of every node that has a link to another; links count both ways.

    Each partition's union-find leaves a forest.  Then large-star (a node's larger neighbours join its smallest one)
    and small-star (its smaller neighbours do) alternate until nothing changes, which takes about log(n) rounds.  The
    smallest neighbour is an aggregate with map-side combining, so a hub with many links is no large group.
    """
    links = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u > v").distinct()
    now = stage(links, "links")
    n = now.count()
    if n > part_links // 10:
        now = now.repartition(rows_per_group(n, part_links))
    else:
        now = now.coalesce(1)
    now = stage(now.mapInArrow(_forest, "u long, v long").distinct(), "links")
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    last = sign(now)
    if n <= part_links // 10:  # one partition had them all
        return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
    while True:
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = stage(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = stage(small.select("e.u", "e.v").filter("u > v").distinct(), "links")
        unstage(now, large)
        now, was, last = small, last, sign(small)
        if last == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def named(rows: DataFrame, group: str, row: str, own_id: str) -> DataFrame:
    """``rows`` with component_id, kept, first: what the rows of one ``group`` (null: a row alone) are called.

    ``component_id`` is the smallest ``own_id`` of the group (null where no row has one), ``kept`` says that it is the row's
    own (without ids: that the row is the first), ``first`` marks one row of each group: smallest id, then smallest ``row``.
    """
    first = F.struct(F.col(own_id).isNull(), F.col(own_id).alias("low"), F.col(row).alias("at"))
    some = rows.filter(F.col(group).isNotNull()).groupBy(group, F.pmod(F.xxhash64(row), F.lit(64)).alias("_part")).agg(F.min(first).alias("_m"))  # a large group in 64 parts first
    least = some.groupBy(group).agg(F.min("_m").alias("_m"))
    out = rows.join(least, group, "left")
    alone = F.col("_m").isNull()
    component = F.when(alone, F.col(own_id)).otherwise(F.col("_m.low"))
    first = alone | (F.col(row) == F.col("_m.at"))
    return out.select(*rows.columns, component.alias("component_id"), F.coalesce(F.col(own_id) == component, component.isNull() & first).alias("kept"), first.alias("first"))
