"""Nested documents as rows of key paths, by variants that are taken apart level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import written


def json_paths(docs: DataFrame, key: str, text: str, items: int | None = None, depth: int = 64) -> DataFrame:
    """``key``, path, kind, value, left_out: a row for each scalar of a JSON text and one for each array (its length as value).

    Of an array the first ``items`` elements are followed (None: all); ``left_out`` counts the others.  What lies deeper than ``depth`` is one row
    of kind ``deeper``; a text that is not JSON, or larger than a variant, one of kind ``invalid``.  Null texts have no rows.  A level is one pass
    over what is left of all documents, so paths of any depth need no schema.
    """
    spark = docs.sparkSession
    now = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.lit("$").alias("path"), F.try_parse_json(text).alias("v"))
    found = None
    for level in range(depth + 1):
        shape = F.substring_index(F.schema_of_variant("v"), "<", 1)
        kind = F.when(F.col("v").isNull(), "invalid").when(F.is_variant_null("v"), "null").otherwise(F.lower(shape))
        now = written(now.withColumn("kind", kind), "variants")
        if now.isEmpty():
            break
        nested = F.col("kind").isin("object", "array")
        n = F.json_array_length(F.to_json("v"))
        is_array = F.col("kind") == "array"
        left = F.when(is_array & F.lit(items is not None), F.greatest(n - F.lit(items or 0), F.lit(0))).otherwise(0)
        shown = F.when(is_array, n.cast("string")).otherwise(F.variant_get("v", "$", "string"))
        own = now.filter(F.col("kind") != "object") if level < depth else now
        deep = F.lit(level == depth) & nested
        part = own.select("_key", "path", F.when(deep, "deeper").otherwise(F.col("kind")).alias("kind"), F.when(~deep, F.when(F.col("kind") == "null", "null").otherwise(shown)).alias("value"), F.when(deep, 0).otherwise(left).alias("left_out"))
        found = part if found is None else found.union(part)
        if level == depth:
            break
        inner = now.filter(nested).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "inner"))
        inner = inner.filter(F.col("name").isNotNull() | F.lit(items is None) | (F.col("pos") < F.lit(items or 0)))
        step = F.when(F.col("name").isNotNull(), F.concat(F.lit("."), "name")).otherwise(F.concat(F.lit("["), "pos", F.lit("]")))
        now = inner.select("_key", F.concat("path", step).alias("path"), F.col("inner").alias("v"))
    if found is None:
        found = docs.select(F.col(key).alias("_key"), *(F.lit("").alias(c) for c in ("path", "kind", "value")), F.lit(0).alias("left_out")).filter("false")
    return found.withColumnRenamed("_key", key)


#: Words of fields that say how a call went.
SIGNAL = r"(?i)error|exception|failure|failed|warning|status|message|reason"


def json_digest(docs: DataFrame, key: str, text: str, fields: int = 80, items: int = 12, width: int = 240) -> DataFrame:
    """``key``, lines, n_fields, left_out: a JSON result's fields as ``path=value`` lines in the order of paths, those that say how a call
    went if there are any; ``left_out`` counts the fields beyond ``fields`` and array elements beyond ``items``."""
    own = json_paths(docs, key, text, items)
    value = F.substring(F.regexp_replace(F.coalesce("value", F.lit("")), r"\s+", " "), 1, width)
    own = own.withColumn("line", F.when(F.col("kind") == "array", F.concat("path", F.lit(".length="), "value")).otherwise(F.concat("path", F.lit("="), value)))
    own = own.withColumn("signal", F.col("line").rlike(SIGNAL))
    # one shuffle by key and no join: neither the documents' counts nor their lines are broadcast
    every = W.partitionBy(key)
    own = own.filter(F.col(key).isNotNull()).withColumn("own", F.col("signal") | ~F.bool_or("signal").over(every))
    own = own.withColumn("rn", F.row_number().over(every.orderBy(F.desc("own"), "path")))
    shown = F.when(F.col("own") & (F.col("rn") <= fields), F.struct("rn", "line"))
    per = own.groupBy(key).agg(F.count_if("own").alias("n_fields"), F.sum("left_out").alias("elements"), F.array_sort(F.collect_list(shown)).alias("shown"))
    lines = F.array_join(F.transform("shown", lambda x: x["line"]), "\n")
    return per.select(key, lines.alias("lines"), "n_fields", (F.greatest(F.col("n_fields") - fields, F.lit(0)) + F.col("elements")).alias("left_out"))
