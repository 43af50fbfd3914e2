"""Each registered query that has an oracle, against DuckDB on the smallest tables."""

import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(DATA):
    pytest.skip("no test tables here", allow_module_level=True)

import __spark_entry__ as entry  # noqa: E402
from codelake.testbed import QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in entry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_cycles_of_nations_are_in_strong_components(spark):
    q = entry.queries()
    members = {r.node for r in q["scc_members"](spark, DATA).collect()}
    found = [r.message.removeprefix("circular dependency: ").split(" -> ") for r in q["cycle_findings"](spark, DATA).collect()]
    assert found and all(set(c) <= members for c in found)
