"""Operator 1: token-id output as a content-addressed store.

File format, below one folder (all Parquet, so that a task's files appear whole or not at all):

``objects/kind=chunk``   digest (blake2b-128 of the ids as little-endian uint32), n, width (2 or 4), data (the ids, ``width`` bytes each)
``recipes``              doc_id, start, n_tokens, digests (the chunks in order), root (Merkle root of the digests); ascending doc_id
``manifest``             part, first_doc, last_doc, n_docs, n_tokens, root: the Merkle root of each run of recipes

Ids are cut where a rolling hash over the last 16 ids ends in zeros, so equal passages give equal chunks wherever
they stand; each distinct chunk is stored once.  A reader recomputes every chunk's digest from the bytes it
reads and every document's root from its recipe, so a document's crc32 can be put together from its chunks'
(crc32 is linear), without bringing any document together in one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, lean, new_path, remove, rows_per_group, stage
from .encode import encoder, with_end

MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 64, 256, 2048
END_ID = 2
RUN_ROWS = 50_000


def _gear(ids: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each id, by the splitmix finalizer."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends of ids at which the rolling hash of the last 16 ends in zeros; those before ``MIN_CHUNK`` ids of a document
    never cut, so ids of several documents can lie one after another."""
    h = _gear(ids)
    for k in (1, 2, 4, 8):  # sum of gear << age over the last 16 ids, by doubling
        h[k:] = h[k:] + (h[:-k] << np.uint64(k))
    return np.flatnonzero(h >> np.uint64(8) & np.uint64(MEAN_CHUNK - 1) == 0) + 1


def cut(first: int, n: int, at: list[int]) -> list[int]:
    """Ends of the chunks of a document's ``n`` ids from the place ``first``; ``at``: the marks inside."""
    ends, last, n = [], first, first + n
    for e in at:
        while e - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if e - last >= MIN_CHUNK:
            ends.append(e)
            last = e
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; the root of nothing is the digest of no bytes."""
    level = [bytes(x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


OBJECT = "kind string, key binary, doc_id long, n long, width int, data binary, digests array<binary>, root binary"


def _objects(path: str, end_id: int):
    schema = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("data", pa.binary()), ("digests", pa.list_(pa.binary())), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path), set()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = {name: [] for name in schema.names}

                def put(*row):
                    for name, x in zip(schema.names, row):
                        rows[name].append(x)

                ids, edges = with_end(*enc.encode_column(part.column("text")), end_id)
                raw, narrow, high = memoryview(ids).cast("B"), memoryview(ids.astype("<u2")).cast("B"), np.flatnonzero(ids > 65535)
                at = marks(ids)
                inside = np.searchsorted(at, edges, side="right").tolist()
                at, edges = at.tolist(), edges.tolist()
                for d, (doc_id, copy) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("copy").to_pylist())):
                    keys, last = [], edges[d]
                    for e in cut(edges[d], edges[d + 1] - edges[d], at[inside[d] : inside[d + 1]]):
                        keys.append(key := digest(raw[4 * last : 4 * e]))
                        if key not in seen:
                            if len(seen) >= 500_000:  # only saves shuffling; the aggregation below is what makes chunks unique
                                seen.clear()
                            seen.add(key)
                            wide = len(high) and np.searchsorted(high, last) < np.searchsorted(high, e)
                            put("chunk", key, None, e - last, 4 if wide else 2, bytes(raw[4 * last : 4 * e] if wide else narrow[2 * last : 2 * e]), None, None)
                        last = e
                    put("recipe", digest(f"{doc_id} {copy}".encode()), doc_id, edges[d + 1] - edges[d], None, None, keys, merkle(keys))
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, run_rows: int = RUN_ROWS) -> None:
    """Encode every whole text, append ``end_id`` and write the store.

    A null or empty text is the end id alone; repeated rows each have a recipe and share their chunks; an empty
    table gives empty files.
    """
    spark = docs.sparkSession
    # a chunk goes to the task of its digest, a recipe to that of its row's digest
    found = documents(docs).withColumn("copy", F.monotonically_increasing_id()).mapInArrow(lean(_objects(tokenizer, end_id)), OBJECT)
    one = found.groupBy("kind", "key").agg(*[F.first(c).alias(c) for c in ("doc_id", "n", "width", "data", "digests", "root")])
    one.write.partitionBy("kind").parquet(f"{path}/objects")
    objects = spark.read.schema("kind string, " + OBJECT.partition(", ")[2]).parquet(f"{path}/objects")
    recipes = objects.filter("kind = 'recipe'").select("doc_id", F.col("n").alias("n_tokens"), "digests", "root")
    runs = rows_per_group(recipes.count(), run_rows)
    recipes = recipes.repartitionByRange(runs, "doc_id", "root").sortWithinPartitions("doc_id", "root").select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "*")
    recipes.write.parquet(f"{path}/sorted")
    recipes = spark.read.parquet(f"{path}/sorted")
    parts = recipes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))  # a row a run
    inside = W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    placed = recipes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    placed = placed.select("part", "at", "doc_id", (F.col("earlier") + F.col("inside")).alias("start"), "n_tokens", "digests", "root")
    placed.repartitionByRange(runs, "at").sortWithinPartitions("at").write.parquet(f"{path}/recipes")
    remove(spark, f"{path}/sorted")

    runs_of(spark, path).write.parquet(f"{path}/manifest")


RUN = "part int, first_doc long, last_doc long, n_docs long, n_tokens long, root binary"


def runs_of(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's rows as the recipes there make them."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        ids = group.column("doc_id")
        row = [key[0].as_py(), ids[0].as_py(), ids[-1].as_py(), len(group), pc.sum(group.column("n_tokens")).as_py(), merkle(group.column("root").to_pylist())]
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.binary()]
        return pa.table([pa.array([x], t) for x, t in zip(row, kinds)], names=["part", "first_doc", "last_doc", "n_docs", "n_tokens", "root"])

    recipes = spark.read.parquet(f"{path}/recipes").select("part", "at", "doc_id", "n_tokens", "root")
    return recipes.groupBy("part").applyInArrow(run, RUN)


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, agrees, lost for each run of recipes: held against the manifest in count, tokens, ends and Merkle root.

    ``lost``: the manifest has a run that no recipe is left of (``agrees`` is false then, and for runs it does not have).
    """
    names = ("first_doc", "last_doc", "n_docs", "n_tokens", "root")
    now = runs_of(spark, path).select("part", F.struct(*names).alias("now"))
    then = spark.read.schema(RUN).parquet(f"{path}/manifest").select("part", F.struct(*names).alias("then"))
    return now.join(then, "part", "full").select("part", F.coalesce(F.col("now").eqNullSafe(F.col("then")), F.lit(False)).alias("agrees"), F.col("now").isNull().alias("lost"))


def _multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo crc32's, bits reversed."""
    a, b, out = a.astype(np.uint32), b.astype(np.uint32), np.zeros(len(a), np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a piece with this crc32 adds (by xor) to a text's, with ``n_bytes`` after the piece."""
    out, power, left = crc.astype(np.uint32), np.array([1 << 23], np.uint32), n_bytes.astype(np.uint64)
    while left.any():  # power: x to the 8, 16, 32, ... bits
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            out = out.copy()
            out[odd] = _multiply(out[odd], np.repeat(power, int(odd.sum())))
        power = _multiply(power, power)
        left >>= np.uint64(1)
    return out


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Every chunk's ids as read (uint32 bytes are rebuilt and their digest recomputed): digest, n, crc, whole."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, crcs, wholes = batch.column("key").to_pylist(), [], []
            for key, width, data in zip(keys, batch.column("width").to_pylist(), batch.column("data").to_pylist()):
                raw = np.frombuffer(data, "<u2").astype("<u4").tobytes() if width == 2 else data
                crcs.append(zlib.crc32(raw))
                wholes.append(digest(raw) == key)
            yield pa.RecordBatch.from_pydict({"digest": pa.array(keys, pa.binary()), "n": batch.column("n"), "crc": pa.array(crcs, pa.int64()), "whole": pa.array(wholes, pa.bool_())})

    objects = spark.read.schema("kind string, " + OBJECT.partition(", ")[2]).parquet(f"{path}/objects")
    return objects.filter("kind = 'chunk'").select("key", "n", "width", "data").mapInArrow(lean(verify), "digest binary, n long, crc long, whole boolean")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32, n_chunks, whole.

    ``whole``: every chunk is there with the digest of its bytes, lengths add up, the recipe's Merkle root agrees, and
    so does its run's with the manifest.  A run of the manifest without any recipe left is an error.
    """
    checked = stage(verify_manifest(spark, path), "manifest-check")
    if lost := checked.filter("lost").count():
        raise ValueError(f"{path}: no recipes are left of {lost} runs of the manifest")

    @F.pandas_udf("long")
    def share(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(shift_crc(crc.fillna(0).to_numpy(), (4 * after).to_numpy()).astype(np.int64))

    @F.pandas_udf("boolean")
    def rooted(digests: pd.Series, root: pd.Series) -> pd.Series:
        return pd.Series([merkle(list(d)) == bytes(r) for d, r in zip(digests, root)])

    recipes = spark.read.parquet(f"{path}/recipes").join(checked.select("part", "agrees"), "part")
    recipes = recipes.withColumn("rooted", rooted("digests", "root") & F.col("agrees"))
    refs = recipes.select("at", "doc_id", "start", "n_tokens", "rooted", F.size("digests").alias("n_chunks"), F.posexplode("digests").alias("pos", "digest"))
    refs = refs.join(read_chunks(spark, path), "digest", "left")
    upto = W.partitionBy("at").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    refs = refs.withColumn("after", F.greatest(F.col("n_tokens") - F.sum(F.coalesce("n", F.lit(0))).over(upto), F.lit(0)))
    refs = refs.withColumn("part", share("crc", "after"))
    return refs.groupBy("at").agg(
        F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("n_tokens").alias("n_tokens"),
        F.bit_xor("part").alias("ids_crc32"), F.first("n_chunks").alias("n_chunks"),
        (F.bool_and(F.coalesce("whole", F.lit(False))) & F.first("rooted") & (F.sum("n") == F.first("n_tokens"))).alias("whole"),
    ).drop("at")


def read_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """The ids of a few documents, rebuilt from their chunks."""
    want = spark.read.parquet(f"{path}/recipes").filter(F.col("doc_id").isin(doc_ids))
    refs = want.select("doc_id", F.posexplode("digests").alias("pos", "key"))
    objects = spark.read.schema("kind string, " + OBJECT.partition(", ")[2]).parquet(f"{path}/objects").filter("kind = 'chunk'")
    out: dict[int, list[int]] = {}
    for r in refs.join(objects.select("key", "width", "data"), "key").orderBy("doc_id", "pos").collect():
        out.setdefault(r.doc_id, []).extend(np.frombuffer(r.data, f"<u{r.width}").tolist())
    return out


def store_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the store to the shared folder and return what is read back from it."""
    path = new_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer)
    return read_digests(docs.sparkSession, path)
