"""Incremental refresh of fact tables from batches of changed files, idempotent by batch.

Facts lie in buckets of their file's path.  A batch rewrites the buckets that its files fall in, beside the old ones, and then one version
of the pointer names every bucket's folder and the batch.  A batch that is handed over again after a crash finds either its own
number in the pointer, and changes nothing, or no trace but unnamed files, and is done anew; readers never see half of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions


def _bucket(buckets: int, path: str = "path"):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def pointer(spark: SparkSession, base: str) -> tuple[int, dict]:
    """Version and content of the pointer: ``batch`` (the last one done), ``buckets`` (table, bucket: folder)."""
    version, body = versions.read_version(spark, f"{base}/_current")
    return version, body or {"batch": None, "buckets": {}, "n": None}


def facts(spark: SparkSession, base: str, table: str, schema: str, only: set[int] | None = None) -> DataFrame:
    """A table as of the pointer (only some of its buckets, if they are named)."""
    _, body = pointer(spark, base)
    folders = [f"{base}/{d}" for b, d in body["buckets"].get(table, {}).items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def refresh(spark: SparkSession, base: str, batch_id: int, changes: DataFrame, derive: Callable[[DataFrame], dict[str, DataFrame]], schemas: dict[str, str], order: str = "seq", buckets: int = 64) -> bool:
    """One batch of changes (path, deleted, ``order`` and what ``derive`` reads); False if it was done before.

    Of several changes of a path the last one by ``order`` counts.  ``derive`` gives the fact tables (with ``path``) of changed files; facts of
    changed and deleted files go, those come.  A store keeps the number of buckets that it began with.
    """
    version, body = pointer(spark, base)
    if body["batch"] is not None and body["batch"] >= batch_id:
        return False
    n = body["n"] or buckets
    rest = [c for c in changes.columns if c != "path"]
    last = changes.filter("path is not null").groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("c")).select("path", "c.*").persist()
    try:
        hit = sorted(r.b for r in last.select(_bucket(n).alias("b")).distinct().collect())  # at most n numbers
        fresh = derive(last.filter("not coalesce(deleted, false)"))
        now = {t: dict(body["buckets"].get(t, {})) for t in schemas}
        for t, schema in schemas.items() if hit else ():
            old = facts(spark, base, t, schema, set(hit)).join(last.select("path"), "path", "left_anti")
            out = f"{t}/batch={batch_id}"
            rows = old.select(*fresh[t].columns).unionByName(fresh[t]).withColumn("bucket", _bucket(n))
            rows.repartition(len(hit), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/{out}")
            fs, at = versions._fs(spark, f"{base}/{out}")
            made = {s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(at)}
            for b in map(str, hit):
                now[t].pop(b, None)
                if b in made:
                    now[t][b] = f"{out}/bucket={b}"
        versions.append(spark, f"{base}/_current", {"batch": batch_id, "buckets": now, "n": n}, version)
    finally:
        last.unpersist()
    return True


def refresh_stream(stream: DataFrame, base: str, derive: Callable[[DataFrame], dict[str, DataFrame]], schemas: dict[str, str], checkpoint: str, order: str = "seq", buckets: int = 64, **trigger):
    """``refresh`` for each micro-batch of a stream of changes; the checkpoint and the pointer together make each batch count once."""
    spark = stream.sparkSession
    act = lambda df, n: refresh(spark, base, n, df, derive, schemas, order, buckets)
    return stream.writeStream.foreachBatch(lambda df, n: act(df, n) and None).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
