"""Operator 9 [native]: shards by proportional stratified interleaving.

Rows of each source are put in a seeded random order; row r of n has the fractional rank (r + 1/2) / n.  All rows
sorted by fractional rank interleave the sources in proportion, so every run of that order has the corpus's
mixture; it is cut into shards whose row counts differ by one at most.

Neither order is made in one task: rows are dealt to cells by the leading bits of their seeded hash (or of
their fractional rank), cells are counted, and a row's rank is the rows in earlier cells plus its rank in its
own cell.  A source with a third of all rows is spread over as many cells as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import rows_per_group, stage

CELL_ROWS = 2_500


def _earlier(count: DataFrame, *by: str, chunk: int = 4096) -> DataFrame:
    """``count`` (by, cell, c) with ``earlier``, the rows in earlier cells, and ``total``, all rows.  Sums of ``chunk`` cells are ordered
    first, then the cells of each chunk, so that no task orders all cells."""
    before = lambda order, *keys: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    count = count.withColumn("chunk", F.floor(F.col("cell") / chunk))
    sums = count.groupBy(*by, "chunk").agg(F.sum("c").alias("t"))
    sums = sums.select(*by, "chunk", F.coalesce(F.sum("t").over(before("chunk", *by)), F.lit(0)).alias("base"), F.sum("t").over(W.partitionBy(*by)).alias("total"))
    inside = F.coalesce(F.sum("c").over(before("cell", *by, "chunk")), F.lit(0))
    return count.join(sums, [*by, "chunk"]).select(*by, "cell", (F.col("base") + inside).alias("earlier"), "total")


def interleave(docs: DataFrame, n_shards: int = 8, seed: str = "mix", cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes (size 1, crc32 0); a null source is a stratum of its own; rows without an id are shuffled by their
    place; rows of one id follow one another within their source, and equal rows each take a slot of their own (their order among
    themselves is free); texts of any length count whole; no rows give no rows.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("\0null")).alias("source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.monotonically_increasing_id())))).alias("mixed"),
    )
    base = stage(base, "shard-rows")  # texts are read once, and a row's place stays what it was
    n = base.count()
    cells = rows_per_group(n, cell_rows)
    base = base.withColumn("cell", F.expr(f"cast(floor(conv(substring(mixed, 1, 8), 16, 10) * {cells}D / 4294967296D) as int)"))
    count = _earlier(base.groupBy("source", "cell").agg(F.count(F.lit(1)).alias("c")), "source")
    rank = F.row_number().over(W.partitionBy("source", "cell").orderBy("mixed", "doc_id")) - 1
    ranked = base.withColumn("r", rank).join(count, ["source", "cell"])
    ranked = ranked.select(
        "doc_id", "source", "size", "text_crc32", "mixed",
        ((2 * (F.col("r") + F.col("earlier")) + 1) / (2 * F.col("total"))).alias("part"),
    )
    ranked = stage(ranked.withColumn("cell", F.floor(F.col("part") * cells).cast("int")), "shard-rank")
    count = _earlier(ranked.groupBy("cell").agg(F.count(F.lit(1)).alias("c"))).drop("total")
    rank = F.row_number().over(W.partitionBy("cell").orderBy("part", "mixed", "doc_id")) - 1
    placed = ranked.withColumn("r", rank).join(count, "cell").withColumn("g", F.col("r") + F.col("earlier"))
    shard = F.expr(f"cast(g * {n_shards} div {max(n, 1)} as int)")
    return placed.withColumn("shard", shard).select(
        "doc_id", "source", "size", "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"cast(g - (cast(shard as bigint) * {n} + {n_shards - 1}) div {n_shards} as bigint)").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
