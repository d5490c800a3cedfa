"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from probelake.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.sql(f"create view {t.split('.')[0]} as select * from '{DIR}/{t}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: None if x is None else str(x) if isinstance(x, (str, bool)) else f"{float(x):.5f}"
    return sorted([tuple(plain(v[i]) for i in order) for v in values], key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, DIR)
    found = got.collect()
    if name in ORACLES:
        want = sql.sql(ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, found) == rows(want.columns, want.fetchall())
    else:
        assert found
