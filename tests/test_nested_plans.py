"""Digests of nested documents are made without joins."""

from graphloom.sources import nested as J


def test_a_digest_joins_nothing(spark):
    """One document a row: a join of documents with their counts or lines would broadcast or shuffle all of them again."""
    docs = spark.range(50).selectExpr("id", """concat('{"status":"', CASE WHEN id % 2 = 0 THEN 'ok' END, '","a":[1,2,3],"b":', id, '}') AS t""")
    found = J.json_digest(docs.filter("t IS NOT NULL"), "id", "t", fields=2, items=2)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id % 2, r.lines, r.n_fields, r.left_out) for r in found.collect()} == {(0, "$.status=ok", 1, 1)}
