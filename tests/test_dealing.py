"""Rows of a table that lies in one row group are worked on in several tasks."""

import os

import pytest
from pyspark.sql import functions as F

from bindings.loads import customer_postings
from bindings.registry import posting_documents, postings

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not present")


@pytest.fixture(scope="module")
def one_group(spark, tmp_path_factory):
    """The small tables with 400,000 orders and customers, each in a single row group."""
    folder = str(tmp_path_factory.mktemp("one-group"))
    for name in ("region", "nation"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    spark.range(0, 400_000, 1, 1).select(
        F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), F.sha1(F.col("id").cast("string"))).alias("c_name"),
        (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("FURNITURE").alias("c_mktsegment"),
    ).write.parquet(f"{folder}/customer.parquet")
    spark.range(0, 400_000, 1, 1).select(
        F.col("id").alias("o_orderkey"), (F.xxhash64("id") % 200_000 + 200_000).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
        (F.col("id") + F.rand(1)).alias("o_totalprice"), F.lit("2-HIGH").alias("o_orderpriority"),
    ).write.parquet(f"{folder}/orders.parquet")
    return folder


def parts(df, key):
    """(rows, tasks with rows, are keys in the order of tasks)"""
    by_task = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    rows = by_task.orderBy("task").collect()
    return sum(r["n"] for r in rows), len(rows), all(a["high"] < b["low"] for a, b in zip(rows, rows[1:]))


def test_postings_are_dealt_in_order(spark, one_group):
    for derived in (postings, posting_documents):
        rows, tasks, ordered = parts(derived(spark, one_group), "id")
        assert rows == 400_000 and tasks > 1 and ordered


def test_customer_postings_are_dealt_in_order(spark, one_group):
    rows, tasks, ordered = parts(customer_postings(spark, one_group), "c_custkey")
    assert rows == 400_000 and tasks > 1 and ordered
