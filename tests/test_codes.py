"""Keys with more than eight base-4 digits against the SQL."""

from datetime import datetime
from itertools import product

import duckdb
import pytest

from probelake.plans import queries as q

KEYS = [*range(8), *range(65_530, 65_545), 65_536 * 3 + 7, 899_999]


def against_sql(spark, tmp_path, table, name):
    c = duckdb.connect()
    c.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    want = c.sql(q.ORACLES[name])
    got = q.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name", ["two_part_barcodes", "whitelist_exact", "whitelist_indels", "whitelist_pigeonhole"])
def test_long_customer_keys(spark, tmp_path, name):
    spark.createDataFrame([(k,) for k in KEYS], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    against_sql(spark, tmp_path, "customer", name)


def test_negative_customer_keys(spark, tmp_path):
    spark.createDataFrame([(k,) for k in [*range(-70, 20), *range(-65_545, -65_530), -899_999]], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    against_sql(spark, tmp_path, "customer", "two_part_barcodes")


def test_negative_keys_of_whole_entries(spark, tmp_path):
    # Without a digit -1, so that the SQL's entries have one length.
    keys = [-sum(d * 4**i for i, d in enumerate(ds)) for ds in product((0, 2, 3), repeat=4)] + [-(65_536 * 3 + 11), 5, 6]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    against_sql(spark, tmp_path, "customer", "whitelist_pigeonhole")


def test_long_cell_keys(spark, tmp_path):
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = [(i, datetime(2024, 1, 1), KEYS[i % len(KEYS)], kinds[i % 5], 1.0, f'{{"k": {i % 100}}}') for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    against_sql(spark, tmp_path, "events", "map_reads")
