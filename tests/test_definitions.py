"""The best definition of a callee, against scoring every symbol of its name."""

import random

from pyspark.sql import functions as F

from graphloom.operators import ranking as K


def test_best_definitions_are_those_of_all_symbols(spark):
    rng = random.Random(3)
    paths = ["a/b/X.java", "a/b/Y.java", "a/c/X.ts", "b/X.java", "X.java", "tests/fixtures/one/a/X.java", "q/tests/fixtures/one/X.ts", "tests/fixtures/two/X.java", "a//b/X.java", "", "a/noext"]
    owners = ["p.A", "p.q.A", "P.main.new.A", "A", "p.main", ""]
    symbols = [(f"{o}.{n}" if o else n, n, rng.choice(["method", "class", "field", "enum", "function"]), f, rng.choice(["main_source", "test_source", "generated", None]), rng.randint(1, 4)) for o in owners for n in ("main", "Main", "New", "new", "A") for f in paths]
    s = spark.createDataFrame(symbols, "fq_name string, name string, kind string, file string, role string, line long")
    calls = ["main", "A.main", "p.A.main(int)", "q.A.Main.new", "Main.new()", "p.main.new", "x.A.new", "A.New", "new", "P.main.new.A.new", "zzz.main", "none"]
    e = spark.createDataFrame([(c, f) for c in calls for f in [*paths, "z/X.java", None]], "callee string, file string")
    name = F.lower(F.substring_index(F.regexp_replace(F.regexp_replace("callee", r"\([^)]*\)$", ""), r"\.new$", ""), ".", -1))
    every = e.select("callee", F.col("file").alias("edge_file")).join(s, name == F.lower("name")).withColumn("score", K.definition_score(F.col("callee"), F.col("edge_file")).cast("bigint"))
    want = every.groupBy("callee", "edge_file").agg(F.min(F.struct((-F.col("score")).alias("s"), "line", "fq_name", "file")).alias("b")).select("callee", "edge_file", "b.fq_name", "b.file", (-F.col("b.s")).alias("score"))
    got = K.best_definitions(e, s)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100


def test_a_common_name_is_not_scored_pair_by_pair(spark):
    s = spark.range(2000).selectExpr("concat('p', id % 50, '.C', id, '.main') AS fq_name", "'main' AS name", "'method' AS kind", "concat('p', id % 50, '/C', id, '.java') AS file", "'main_source' AS role", "id AS line")
    e = s.selectExpr("concat(fq_name, '(int)') AS callee", "file")
    assert K.definition_candidates(e, s).count() <= 16 * 2000  # 2000 * 2000 pairs
    assert K.best_definitions(e, s).filter("edge_file = file AND callee = concat(fq_name, '(int)')").count() == 2000
