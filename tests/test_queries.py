"""Every registered engine query against its SQL, in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from driftframe.plans import catalog

SF = "/root/testdata/sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def test_all_have_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) > 60 and set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(SQL[name])
    kinds = {d[0]: str(d[1]) for d in found.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    at = [list(kinds).index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr) and got


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
