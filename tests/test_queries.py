"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from leafmill.plans.registry import ORACLES, QUERIES

DATA = os.environ.get("LEAFMILL_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    rows = sorted((tuple(r) for r in found.select(*columns).collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    sql = duck.sql(ORACLES[name])
    assert columns == sorted(sql.columns)
    quoted = [f'"{c}"' for c in columns]
    assert rows == sorted((tuple(r) for r in sql.select(*quoted).fetchall()), key=repr)
