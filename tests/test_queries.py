"""Every registered query against its SQL on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry_module  # noqa: E402
from check import rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    yield con
    con.close()


def test_registry():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name in SQL:
        cursor = duck.execute(SQL[name])
        assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_fixed_width_records_of_wide_values(spark, tmp_path):
    """Keys of five digits, keys that look like codes for missing values, large, negative and unknown values."""
    users = [0, 49, 9998, 9999, 10049, 89_999, -7, None, 10**15]
    values = [9999.98, 9999.99, 10_000.0, 123_456.789, -0.5, -12.345, None, 1e17, 1.5]
    kinds = ["click", "view", "error", None]
    rows = [(10 * i + j, u, k, v) for i, (u, v) in enumerate([(u, v) for u in users for v in values]) for j, k in enumerate(kinds)]
    path = str(tmp_path / "events.parquet")
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double")
    events.selectExpr("event_id", "TIMESTAMP_NTZ '2024-01-05 06:07:08' AS ts", "user_id", "event_type", "value", "'' AS props").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{path}/*.parquet'")
    df = QUERIES["fixed_width_records"](spark, str(tmp_path))
    cursor = con.execute(SQL["fixed_width_records"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
