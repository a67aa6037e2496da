"""Every registered query against its DuckDB counterpart on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as registered
from bindings.registry import TABLES
from compare import compare

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, duck, name):
    outcome, _ = compare(spark, duck, SF_DIR, name)
    assert outcome.startswith(("ok", "rows only")), outcome


def test_entry(spark):
    assert registered.entry(spark).count() > 0
