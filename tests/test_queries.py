"""Every library query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from affilia.plans import oracle
from affilia.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
SQL = oracle.sql()


def plain(value):
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else str(value)
    return value


def test_every_query_has_sql():
    assert set(SQL) == set(REGISTRY)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = REGISTRY[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    key = lambda row: tuple((x is None, str(x)) for x in row)
    rows = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=key)
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=key)
    assert rows
