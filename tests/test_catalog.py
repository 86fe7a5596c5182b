"""Every registered query against its SQL, on the smallest tables."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402

DATA = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    expect = duck.execute(sql)
    names = [d[0] for d in expect.description]
    at = [names.index(c) for c in columns]
    rows = sorted(str(tuple(r[i] for i in at)) for r in expect.fetchall())
    assert got == rows
    kinds = {d[0]: str(d[1]) for d in duck.execute("DESCRIBE " + sql).fetchall()}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
