"""Specification readers, failure parsing, contracts and import graphs on small inputs."""

import json

from graphloom.operators import failures, impact
from graphloom.sources import specs


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def files(spark, **content):
    return spark.createDataFrame([(k, v) for k, v in content.items()], "path string, content string")


def test_xml_and_mappers(spark):
    f = files(spark, a='<mapper namespace="n.M"><select id="x">SELECT 1</select><insert id="y"/></mapper>', b="<broken", c=None)
    assert rows(specs.xml_facts(f), "path", "tag", "depth") == [("a", "insert", 1), ("a", "mapper", 0), ("a", "select", 1)]
    assert rows(specs.mapper_statements(f), "namespace", "kind", "id") == [("n.M", "insert", "y"), ("n.M", "select", "x")]


def test_openapi_and_postman(spark):
    api = {"swagger": "2.0", "basePath": "/v1", "paths": {"/a": {"get": {"operationId": "readA"}, "parameters": []}, "/b/{id}": {"post": {}}}}
    f = files(spark, a=json.dumps(api), b="{", c=None, d=json.dumps({"paths": {}}))
    assert rows(specs.openapi_endpoints(f), "method", "route") == [("GET", "/v1/a"), ("POST", "/v1/b/{id}")]
    c = {"info": {"name": "c"}, "item": [{"name": "folder", "item": [{"name": "one", "request": {"method": "put", "url": {"raw": "https://h/x/y?q=1"}}}]}, {"name": "two", "request": {"url": "{{host}}/z"}}]}
    f = files(spark, a=json.dumps(c), b="[1]", c="x", d=None)
    assert rows(specs.postman_endpoints(f), "method", "route", "name") == [("GET", "/z", "two"), ("PUT", "/x/y", "one")]


def test_scip(spark):
    o = [{"range": [0, 0, 1], "enclosingRange": [0, 0, 20, 1], "symbol": "C", "symbolRoles": 1}, {"range": [4, 0, 1], "enclosingRange": [4, 0, 9, 1], "symbol": "C.m", "symbolRoles": 1}, {"range": [5, 2, 4], "symbol": "D.n"}, {"range": [15, 2, 4], "symbol": "D.k"}, {"range": [30, 2, 4], "symbol": "D.z"}]
    f = files(spark, i=json.dumps({"documents": [{"relativePath": "c.ts", "occurrences": o}]}))
    assert rows(specs.scip_calls(f), "line", "caller", "callee") == [(6, "C.m", "D.n"), (16, "C", "D.k")]


def test_failures(spark):
    text = "src/a.ts(3,5): error TS1: bad\n[ERROR] /p/B.java:[30,2] no symbol\nx.py:7: wrong\n\tat org.x.Y.run(Y.java:12)\nx.py:7: wrong\nplain"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    assert rows(failures.errors(df), "file", "line", "from_line") == [("/p/B.java", 30, 5), ("Y.java", 12, 1), ("src/a.ts", 3, 1), ("x.py", 7, 1)]
    trace = "E: x\n\tat java.lang.A.b(A.java:1)\n\tat org.springframework.C.d(C.java:2)\n\tat my.E.f(E.java:3)\nsame\nsame"
    out = failures.compressed_trace(spark.createDataFrame([(1, trace)], "id long, text string")).orderBy("k").collect()
    assert [r.line for r in out] == ["E: x", "\t... 2 framework frames", "\tat my.E.f(E.java:3)", "same"]


def test_java_diff(spark):
    d = "--- a/A.java\n+++ b/A.java\n@@ -1,2 +1,3 @@\n import x;\n+import y;\n+@Bean\n-    public void f(int a) {\n+    public void f(long a) {\n"
    got = failures.diff_categories(spark.createDataFrame([(1, d)], "id long, diff string"))
    assert rows(got, "file", "added", "removed", "annotations", "signatures", "imports") == [("A.java", 3, 1, 1, 2, 1)]


def test_contracts_and_export(spark):
    f = spark.createDataFrame([("s/UserController.java",), ("s/user_schema.sql",), ("t/other.md",)], "path string")
    changed = spark.createDataFrame([("s/User.java",)], "path string")
    assert rows(failures.contracts(f, changed), "path", "type") == [("s/UserController.java", "api"), ("s/user_schema.sql", "schema")]
    assert rows(failures.missing_contracts(f, changed), "type") == [("docs",), ("messaging",), ("security",), ("test",)]
    e = spark.createDataFrame([("a", "b", "calls", 2)], "source string, target string, type string, edge_count long")
    assert failures.graph_json(e).count() == 3


def test_import_graph(spark):
    i = spark.createDataFrame([("src/x/a.ts", "./b"), ("src/x/a.ts", "../c"), ("src/x/a.ts", "lib"), ("src/x/a.ts", "./a"), ("src/x/a.ts", "./none")], "path string, specifier string")
    f = spark.createDataFrame([("src/x/a.ts",), ("src/x/b.ts",), ("src/x/b/index.ts",), ("src/c/index.ts",)], "path string")
    assert rows(impact.import_graph(i, f), "importer", "target") == [("src/x/a.ts", "src/c/index.ts"), ("src/x/a.ts", "src/x/b.ts")]


def test_calculations(spark):
    lines = spark.createDataFrame([("a", "total = x + y"), ("b", "total = round(x)"), ("b", "if (total == 3)"), ("c", None)], "file string, line string")
    assert rows(impact.calculation_sinks(lines), "output", "n", "n_files", "risk") == [("total", 2, 2, 2)]
