"""Phases of task checkpoints, and the state of their claims (``versions`` keeps the checkpoints)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: The phases that may follow each phase (every phase may stay).
TRANSITIONS = {"discovery": ("impact", "implementation"), "impact": ("implementation",), "implementation": ("verification",), "verification": ("implementation", "review", "complete"), "review": ("implementation", "verification", "complete"), "complete": ()}


def transitions(checkpoints: DataFrame) -> DataFrame:
    """task, version, phase, before, allowed: each version's phase against the one before it."""
    rows = checkpoints.withColumn("before", F.lag("phase").over(W.partitionBy("task").orderBy("version")))
    ok = F.col("before").isNull() | (F.col("before") == F.col("phase"))
    for a, following in TRANSITIONS.items():
        if following:
            ok = ok | ((F.col("before") == a) & F.col("phase").isin(*following))
    return rows.select("task", "version", "phase", "before", (ok & F.col("phase").isin(*TRANSITIONS)).alias("allowed"))


def claim_status(claims: DataFrame, files: DataFrame, slices: DataFrame) -> DataFrame:
    """id, status of claims (id, file, file_hash, slice_hash, line, width) against files (file, hash) and the hashes of
    their slices of that width (file, line, width, hash): fresh, relocated, stale, missing or ambiguous."""
    now = claims.join(files.select("file", F.col("hash").alias("now")), "file", "left")
    met = now.join(slices.select("file", "width", F.col("line").alias("at"), F.col("hash").alias("slice_hash")), ["file", "width", "slice_hash"], "left")
    n = met.groupBy("id").agg(F.first("now").alias("now"), F.first("file_hash").alias("file_hash"), F.first("slice_hash").alias("slice_hash"), F.count("at").alias("n"), F.coalesce(F.bool_or(F.col("at") == F.col("line")), F.lit(False)).alias("here"))
    status = (
        F.when(F.col("now").isNull(), "missing").when(F.col("file_hash") == F.col("now"), "fresh").when(F.col("here") | (F.col("n") == 1), "relocated")
        .when(F.col("file_hash").isNull() & F.col("slice_hash").isNull(), "ambiguous").otherwise("stale")
    )
    return n.select("id", status.alias("status"))
