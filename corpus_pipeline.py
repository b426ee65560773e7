"""The training-data pipeline: quality, toxicity, near-duplicates, packing, over ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import importance, minhash, packing, toxicity
from graphloom.llm.common import new_path, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that importance resampling draws.

    Rows of one id are each drawn or not by their own text; rows without an id take part like any other; a null or empty
    text is drawn after all others.  Without labelled good rows every row stays; an empty table stays empty.
    """
    return importance.resample(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).filter("sampled").select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the multiple-instance model does not call toxic, each by its own text; a null or empty text is not toxic."""
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at 0.8 or more: that of the smallest doc_id, null ids last.

    Repeated rows are one group; rows without words are each kept.
    """
    return minhash.first_of_groups(docs, COLUMNS, width=5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, each with its place in a sequence of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("packing", packed)]

#: No SQL for trained models, verified hashing and tokenizers; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):  # what a stage staged on its way goes when its result is written
            f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
