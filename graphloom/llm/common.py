"""Shared tables, session settings and small helpers of the training-data operators.

Every intermediate table goes to the folder the session names in ``spark.checkpoint.dir``, which all
executors can read, so that a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark SQL's pattern for one word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Staged tables' paths in the order they were made (``scratch`` deletes those of a step).
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where a local session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _made.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_staged_path", None):
            remove(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end: what is still needed must have been written elsewhere."""
    first = len(_made)
    try:
        yield
    finally:
        for path in _made[first:]:
            remove(spark, path)
        del _made[first:]


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch to a Python worker: texts are long, and an executor's workers hold a batch and what is made of it.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let no Arrow batch be larger than ``BATCH_BYTES`` from now on (a session that asks for less is left as it is)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", spark.conf.get(name, f"{1 << 30}b").strip().lower())
    if not now or not 0 < int(now[1]) << 10 * " kmgtp".index(now[2] or " ") <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, and what it has freed given back to the system at the end of each task: Python workers outlive tasks."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return task


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) and the named columns; other columns can't clash with ours."""
    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *columns)


def carried(df: DataFrame, carry: tuple[str, ...], *extra: Column) -> tuple[DataFrame, dict[str, str], str]:
    """``_id``, ``_text``, ``extra`` and the columns ``carry`` of ``df`` under names of their own, those names, and their types.

    An operator that hands these columns through its Python workers needs no join to bring its result back to them.
    """
    small_batches(df.sparkSession)
    names = {c: "_text" if c == "text" else f"c_{c}" for c in carry}
    own = df.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), *extra, *(F.col(c).alias(n) for c, n in names.items() if c != "text"))
    kinds = dict(df.select(*carry).dtypes) if carry else {}
    return own, names, "".join(f", `{n}` {kinds[c]}" for c, n in names.items())


def rows_per_group(n: int, size: int) -> int:
    """How many groups of about ``size`` rows ``n`` rows make."""
    return max(1, -(-n // size))


#: Files whose names are broadcast to number a table's rows (some 100 bytes each).
MAX_FILES = 1 << 18


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``df`` and ``row``, a key of each row that every read sees alike: its file and place there.

    What is not a table of files as it is read is written as one first.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        df = stage(df.select(*columns), "rows")
    number = (F.row_number().over(Window.orderBy("file_path")) - 1).cast("long")  # a row a file
    files = stage(df.select("_metadata.file_path").distinct().withColumn("file", number), "files")
    files = F.broadcast(files) if files.count() <= MAX_FILES else files  # more files than that are joined by shuffling
    rows = df.select(*columns, "_metadata.file_path", "_metadata.row_index").join(files, "file_path")
    return rows.select(*columns, (F.shiftleft("file", 40) + F.col("row_index")).alias("row"))
