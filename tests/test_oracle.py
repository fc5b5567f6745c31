"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest
from compare import compare, connect

import __spark_entry__ as registered
from evalloom.plans import all_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_matches_sql(spark, con, name):
    compare(spark, con, QUERIES[name], SQL[name], SF)


def test_entry(spark):
    rows = registered.entry(spark).collect()
    assert {r["model"] for r in rows} == {"alpha", "beta"}


def test_every_own_query_has_sql():
    assert not set(all_queries()) - set(SQL)


def test_ids_of_five_digits(spark, tmp_path):
    """Page ids around and beyond 9,999, which the SQL cuts to four digits."""
    spark.range(9_990, 10_020).withColumnRenamed("id", "page_id").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert compare(spark, con, QUERIES["id_from_file_name"], SQL["id_from_file_name"], str(tmp_path)) == 30
