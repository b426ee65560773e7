"""Every query that has SQL gives DuckDB's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from graphloom.plans import code_queries, graph_queries, inventory_queries, pack_queries, ranking_queries, relational_queries, search_queries, state_queries  # noqa: F401
from graphloom.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return str(x) if not isinstance(x, (int, str, bool, type(None))) else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    cols = sorted(ours.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in ours.collect()), key=repr)
    rel = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
