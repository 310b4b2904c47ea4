"""Every query with oracle SQL against DuckDB on the smallest data."""

import os

import duckdb
import pytest

from lexispan.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    result = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(found.columns) == sorted(names)
    same = lambda v: f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    assert sorted(tuple(map(same, r)) for r in found.select(*names).collect()) == sorted(tuple(map(same, r)) for r in result.fetchall())
