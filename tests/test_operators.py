"""Operators on small literal tables: the cases that their definitions name."""

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph as G
from graphloom.operators import relational as R
from graphloom.operators import review as V
from graphloom.sources import code as C
from graphloom.streaming import logs


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_right_size(spark):
    def kept(scores, **kw):
        df = spark.createDataFrame([(1, k, float(s)) for k, s in enumerate(scores)], "g int, id int, score double")
        return [r[0] for r in rows(R.right_size(df, ["g"], "score", **kw), "id")]

    assert kept([200, 160, 50]) == [0, 1]
    assert kept([288, 95, 93, 40]) == [0, 1, 2]
    assert kept([271, 225, 130]) == [0, 1]
    assert kept([100, 12, 5], min_keep=2) == [0, 1]
    assert kept([0, 0]) == [0, 1]
    assert kept([100, 79]) == [0]


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "a string, b string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert rows(G.reach(edges, seed, 5), "node", "depth") == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(G.trace(edges, seed, 5), "a", "b", "cycle") == [("a", "b", False), ("b", "c", False), ("c", "a", True)]
    up = spark.createDataFrame([("x", "y"), ("y", "x")], "child string, parent string")
    assert rows(G.ancestors(up), "child", "ancestor") == [("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")]


def test_containment(spark):
    spans = spark.createDataFrame([("f", "C", "class", 1, 100), ("f", "C.m", "method", 10, 20)], "file string, fq_name string, kind string, line long, end_line long")
    points = spark.createDataFrame([("f", 15), ("f", 50), ("f", 200)], "file string, at long")
    assert rows(R.containing(points, spans), "at", "fq_name", "how") == [(15, "C.m", "containing"), (50, "C", "containing"), (200, "C.m", "nearest")]


def test_null_role_passes_and_wildcards_are_text(spark):
    f = spark.createDataFrame([("a_b", None), ("axb", "generated")], "name string, role string")
    assert rows(R.visible_files(f), "name") == [("a_b",)]
    assert rows(f.filter(R.contains_text("name", "a_b")), "name") == [("a_b",)]


def test_tokens_and_stems(spark):
    df = spark.createDataFrame([("PaymentService refund",), ("the OrderController of a",), ("*",)], "q string")
    assert [r[0] for r in df.select(T.tokens(F.col("q"))).collect()] == [["payment", "refund"], ["order", "controller"], []]
    w = spark.createDataFrame([("indexing",), ("indexer",), ("call",)], "w string")
    assert [r[0] for r in w.select(T.stem(F.col("w"))).collect()] == ["index", "index", "call"]


def test_snapshot_retention_and_diff(spark):
    s = spark.createDataFrame([("w", k, k, k == 1) for k in range(5)], "w string, id long, created long, current boolean")
    assert rows(R.retained(s, "w", "current", "created", "id"), "id") == [(1,), (3,), (4,)]


def test_diff_hunks_and_risk(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a\n-b\n+password = 1\n+c\n@@ -9 +10 @@\n+d"
    got = rows(C.diff_hunks(spark.createDataFrame([(diff,)], "diff string")), "file", "old_start", "new_start", "added", "removed", "context")
    assert got == [("x.py", 1, 1, 2, 1, 1), ("x.py", 9, 10, 1, 0, 0)]
    one = spark.createDataFrame([("password = 1",)], "t string").select(V.risk_band(V.risk_score(F.col("t"), F.lit(50))).alias("b"))
    assert rows(one, "b") == [("high",)]


def test_source_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("import os\nclass A:\n    def m(self):\n        return os.getcwd()\n")
    (tmp_path / "src/b.ts").write_text("import {x} from './a'\nexport function go() {\n}\n")
    (tmp_path / "app.properties").write_text("a.b = 1\n# no\nc: 2\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/z.js").write_text("1")
    m = C.manifest(spark, str(tmp_path))
    assert rows(m, "path", "language", "role") == [("app.properties", "properties", "resource_config"), ("src/a.py", "python", "main_source"), ("src/b.ts", "typescript", "main_source")]
    facts = rows(C.extract(m), "path", "fact", "name")
    assert ("src/a.py", "method", "m") in facts and ("src/a.py", "call", "getcwd") in facts and ("src/b.ts", "function", "go") in facts and ("src/b.ts", "import", "./a") in facts
    assert rows(C.config_facts(m), "name", "value") == [("a.b", "1"), ("c", "2")]


def test_stream_windows(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("2024-01-01 00:10:00", "a", 2.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 03:00:00", "b", 1.0)], "t string, tool string, duration_ms double").selectExpr("to_timestamp(t) AS ts", "tool", "duration_ms").write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, tool string, duration_ms double").parquet(str(src))
    q = logs.hourly(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("hourly"), "tool", "n", "total_ms") == [("a", 2, 5.0), ("b", 1, 1.0)]


def test_line_set_members(spark):
    same = "first line\nsecond line\nthird line\nfourth line"
    texts = spark.createDataFrame([(5, same), (2, same + "\n}\nshort"), (7, "\n".join(reversed(same.split("\n")))), (1, same + "\nfifth line"), (9, "short")], "id long, text string")
    got = {tuple(r) for r in R.line_set_members(texts, "id", "text").collect()}
    assert got == {(2, 2, 4, 3), (5, 2, 4, 3), (7, 2, 4, 3), (1, 1, 5, 1)}
    assert [tuple(r) for r in R.shared_lines(texts, "id", "text").collect()] == [(1, 2, 4, 1.0)]
