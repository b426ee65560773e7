"""Readers of configuration and specification files: XML, OpenAPI, Postman collections, SCIP indexes.

Each takes files (path, content as text) and gives one row a fact.  Built-in XML and JSON functions do the parsing; only
the nested folders of a Postman collection and XML trees of unknown depth need Python, an Arrow batch at a time.
A document that does not parse gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.relational import BUCKET

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
_XML = "path string, tag string, name string, value string, depth int"
_ENDPOINT = "path string, method string, route string, name string"


def _facts(files: DataFrame, read, schema: str) -> DataFrame:
    """Rows that ``read`` (text to tuples) finds in each file."""
    names = [x.split()[0] for x in schema.split(", ")][1:]
    types = [pa.int32() if x.endswith(" int") else pa.string() for x in schema.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                rows = list(read(text or ""))
                columns = [pa.array([path] * len(rows), pa.string())] + [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", *names])

    return files.select("path", "content").mapInArrow(run, schema)


def xml_facts(files: DataFrame, most: int = 300) -> DataFrame:
    """path, tag, name (its id or name attribute), value (own text), depth of the first ``most`` elements of a file.

    A row ``#cut`` counts the elements left out, and ``#entities`` stands for a file that defines entities.
    """

    def read(text: str) -> Iterator[tuple]:
        if "<!ENTITY" in text:  # entity definitions can expand without bound: the file is named, not read
            yield "#entities", None, None, 0
            return
        try:
            open_now = [(ElementTree.fromstring(text), 0)]
        except (ElementTree.ParseError, ValueError):
            return
        n = 0
        while open_now and n < most:
            node, depth = open_now.pop()
            yield node.tag.rsplit("}", 1)[-1], node.get("id") or node.get("name"), (node.text or "").strip() or None, depth
            n += 1
            open_now.extend((child, depth + 1) for child in reversed(node))
        if open_now:
            yield "#cut", None, str(sum(1 for node, _ in open_now for _ in node.iter())), 0

    return _facts(files, read, _XML)


def mapper_statements(files: DataFrame) -> DataFrame:
    """path, namespace, kind, id of the SQL statements of MyBatis mapper files, by XPath."""
    ns = F.xpath_string("content", F.lit("/mapper/@namespace")).alias("namespace")
    ok = files.filter(F.col("content").contains("<mapper"))

    def of(kind: str) -> Column:
        return F.transform(F.xpath("content", F.lit(f"/mapper/{kind}/@id")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("id")))

    kinds = [of(k) for k in ("select", "insert", "update", "delete")]
    return ok.select("path", ns, F.explode(F.concat(*kinds)).alias("s")).select("path", "namespace", "s.kind", "s.id")


def openapi_endpoints(files: DataFrame) -> DataFrame:
    """path, method, route, name (operationId), confidence of OpenAPI or Swagger documents in JSON."""
    doc = F.from_json("content", "openapi string, swagger string, basePath string, paths map<string, map<string, string>>")
    rows = files.select("path", doc.alias("d")).filter("d.openapi IS NOT NULL OR d.swagger IS NOT NULL")
    rows = rows.select("path", F.coalesce("d.basePath", F.lit("")).alias("base"), F.explode("d.paths").alias("route", "item"))
    rows = rows.select("path", "base", "route", F.explode("item").alias("m", "op")).filter(F.lower("m").isin(*METHODS))
    route = F.regexp_replace(F.concat("base", F.lit("/"), "route"), "/+", "/")
    return rows.select("path", F.upper("m").alias("method"), route.alias("route"), F.get_json_object("op", "$.operationId").alias("name"), F.lit(0.75).alias("confidence"))


def openapi_yaml_endpoints(files: DataFrame) -> DataFrame:
    """path, method, route, name (operationId), confidence of OpenAPI or Swagger documents in block-style YAML, by the indents
    of their lines: routes stand below ``paths``, methods one level below a route, ``operationId`` below a method."""
    doc = files.filter(F.col("content").rlike(r"(?m)^(openapi|swagger)\s*:"))
    rows = doc.select("path", F.posexplode(F.split("content", "\r?\n")).alias("k", "l")).filter(F.trim("l").rlike("^[^#]"))
    rows = rows.select("path", "k", "l", F.length(F.regexp_extract("l", "^( *)", 1)).alias("d"))
    w = W.partitionBy("path").orderBy("k").rowsBetween(W.unboundedPreceding, 0)  # one document's lines
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    rows = rows.withColumn("top", last(F.when(F.col("d") == 0, F.regexp_extract("l", r"^([\w-]+)\s*:", 1))))
    rows = rows.withColumn("base", last(F.when(F.col("l").rlike(r"^basePath\s*:"), F.trim(F.regexp_extract("l", r"^basePath\s*:\s*[\"']?([^\"'#]*)", 1)))))
    route = F.when((F.col("top") == "paths") & F.col("l").rlike(r"^ +[\"']?/"), F.struct("d", F.regexp_extract("l", r"^ +[\"']?(/[^\"':]*)[\"']?\s*:", 1).alias("r")))
    rows = rows.withColumn("route", last(route))
    method = F.lower(F.regexp_extract("l", r"^ +(\w+)\s*:", 1))
    opens = (F.col("top") == "paths") & F.col("route").isNotNull() & (F.col("d") > F.col("route.d")) & method.isin(*METHODS)
    rows = rows.withColumn("m", last(F.when(opens, F.struct("k", "d", method.alias("m")))))
    name = F.when(F.col("l").rlike(r"^ +operationId\s*:") & (F.col("d") > F.col("m.d")), F.trim(F.regexp_extract("l", r":\s*[\"']?([^\"'#]*)", 1)))
    found = rows.filter("m IS NOT NULL AND k >= m.k").groupBy("path", "m").agg(F.first("route", ignorenulls=True).alias("route"), F.max("base").alias("base"), F.min(name).alias("name"))
    full = F.regexp_replace(F.concat(F.coalesce("base", F.lit("")), F.lit("/"), F.col("route.r")), "/+", "/")
    return found.select("path", F.upper("m.m").alias("method"), full.alias("route"), "name", F.lit(0.75).alias("confidence"))


def elastic_endpoints(files: DataFrame) -> DataFrame:
    """path, method, route, name, confidence of Elastic REST specifications in JSON: each API's paths and their methods."""
    doc = F.from_json("content", "map<string, struct<url: struct<paths: array<struct<path: string, methods: array<string>>>>>>")
    rows = files.select("path", F.explode(doc).alias("name", "api")).filter("api.url.paths IS NOT NULL")
    rows = rows.select("path", "name", F.explode("api.url.paths").alias("p")).select("path", "name", F.col("p.path").alias("route"), F.explode("p.methods").alias("m"))
    return rows.select("path", F.upper("m").alias("method"), "route", "name", F.lit(0.75).alias("confidence"))


def postman_endpoints(files: DataFrame) -> DataFrame:
    """path, method, route, name of the requests of Postman collections, whatever folder they are in."""

    def read(text: str) -> Iterator[tuple]:
        try:
            doc = json.loads(text)
        except ValueError:
            return
        items = [doc] if isinstance(doc, dict) and isinstance(doc.get("info"), dict) else []
        while items:
            item = items.pop()
            if not isinstance(item, dict):
                continue
            request = item.get("request")
            if isinstance(request, dict):
                url = request.get("url")
                raw = url.get("raw") if isinstance(url, dict) else url
                route = str(raw or "").split("?", 1)[0]
                route = "/" + route.split("://", 1)[-1].partition("/")[2] if "://" in route or route.startswith("{{") else route
                yield str(request.get("method") or "GET").upper(), route, item.get("name")
            if isinstance(item.get("item"), list):
                items.extend(reversed(item["item"]))

    return _facts(files, read, _ENDPOINT)


_SCIP = "documents array<struct<relativePath: string, occurrences: array<struct<range: array<int>, enclosingRange: array<int>, symbol: string, symbolRoles: int>>>>"


def _line(c: Column, end: bool = False) -> Column:
    """First or last line, from 1, of [line, from, to] or [line, from, end line, to]."""
    return F.when(F.size(c) == 4, F.get(c, F.lit(2 if end else 0))).otherwise(F.get(c, F.lit(0))) + 1


def scip_occurrences(files: DataFrame) -> DataFrame:
    """file, symbol, line, end_line, is_definition of SCIP indexes in JSON."""
    rows = files.select(F.explode(F.from_json("content", _SCIP)["documents"]).alias("d")).select("d.relativePath", F.explode("d.occurrences").alias("o"))
    around = F.coalesce("o.enclosingRange", "o.range")
    return rows.select(F.col("relativePath").alias("file"), "o.symbol", _line(F.col("o.range")).alias("line"), _line(around, True).alias("end_line"), (F.coalesce("o.symbolRoles", F.lit(0)).bitwiseAND(1) == 1).alias("is_definition"))


def scip_calls(files: DataFrame) -> DataFrame:
    """file, line, caller, callee: each reference with the smallest definition of its file that holds its line."""
    rows = scip_occurrences(files)
    at = rows.filter("NOT is_definition").select("file", "line", F.col("symbol").alias("callee"))
    spans = rows.filter("is_definition").select("file", F.col("symbol").alias("caller"), F.col("line").alias("a"), F.col("end_line").alias("z"))
    # lines and spans meet by file and bucket of lines
    dealt = spans.filter("z >= a").withColumn("_b", F.explode(F.sequence(F.floor(F.col("a") / BUCKET), F.floor(F.col("z") / BUCKET))))
    held = at.distinct().withColumn("_b", F.floor(F.col("line") / BUCKET)).join(dealt, ["file", "_b"]).filter("a <= line AND line <= z")
    w = W.partitionBy("file", "line", "callee").orderBy(F.col("z") - F.col("a"), F.desc("a"), "caller")
    return held.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("file", "line", "caller", "callee")
