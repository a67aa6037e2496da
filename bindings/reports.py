"""The four reports over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import query, table
from hirelake.functions.display import dollars, position_in
from hirelake.operators import reports

BUCKETS = ("low", "middle", "high", "none")


@query("""
WITH s AS (SELECT c_mktsegment, r_name, n_name, count(*) AS posting_count,
  cast(sum(cast(o_totalprice AS decimal(12,2))) * 100 AS bigint) AS c
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice IS NOT NULL GROUP BY ALL),
g AS (SELECT *, (2 * c + posting_count) // (2 * posting_count) AS cents FROM s)
SELECT c_mktsegment, r_name, n_name, posting_count, cents / 100.0 AS avg_value,
  cast(dense_rank() OVER (PARTITION BY c_mktsegment, r_name ORDER BY cents DESC) AS int) AS salary_rank FROM g""")
def location_salary_rank(spark, sf_dir):
    """Only four columns of the facts are read; the dimensions are small enough to be broadcast by their file size."""
    spend = table(spark, sf_dir, "orders").filter(F.col("o_totalprice").isNotNull()).select(
        "o_custkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = spend.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        places, F.col("c_nationkey") == F.col("n_nationkey"))
    ranked = reports.dense_rank_by_average(
        joined, ["c_mktsegment", "r_name", "n_name"], ["c_mktsegment", "r_name"], "price")
    return ranked.withColumn("avg_value", F.col("avg_value").cast("double"))


@query("""
WITH daily AS (SELECT event_type, cast(ts AS date) AS day, count(*) AS daily_postings
  FROM events WHERE ts IS NOT NULL GROUP BY ALL)
SELECT event_type, day, daily_postings,
  round(avg(daily_postings) OVER w, 2) AS rolling_avg, count(day) OVER w AS days_in_window
FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_7row_volume(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"))
    return reports.rolling_volume(events, "event_type", "day")


@query("""
WITH f AS (SELECT o_orderpriority, l_returnflag, p_name, count(*) AS frequency
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
  WHERE o_orderpriority IS NOT NULL GROUP BY ALL),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY o_orderpriority, l_returnflag
  ORDER BY frequency DESC, p_name) AS int) AS item_rank FROM f)
SELECT * FROM r WHERE item_rank <= 5""")
def top5_per_group(spark, sf_dir):
    """Names are attached before counting: they repeat, so the combined rows are far fewer than by part key."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isNotNull()).select(
        "o_orderkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey"))
    counts = reports.count_items(named, ["o_orderpriority", "l_returnflag"], "p_name")
    return reports.top_n_per_group(counts, ["o_orderpriority", "l_returnflag"], "p_name", 5)


MATRIX_SQL = """
SELECT l_returnflag, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity BETWEEN 10 AND 30 THEN 'middle'
    WHEN l_quantity > 30 THEN 'high' ELSE 'none' END AS bucket,
  count(*) AS total_listings, min(cast(l_extendedprice AS decimal(12,2))) AS min_value,
  avg(cast(l_extendedprice AS decimal(12,2))) AS avg_value, max(cast(l_extendedprice AS decimal(12,2))) AS max_value
FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY ALL"""


def _matrix(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_quantity", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    return reports.bucket_matrix(lines, "l_returnflag", "l_quantity", "price", "price", "price",
                                 cuts=(10, 30), labels=BUCKETS)


@query(f"""
SELECT l_returnflag, bucket, total_listings,
  cast(CASE bucket WHEN 'low' THEN 1 WHEN 'middle' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS bigint) AS bucket_order,
  concat('$', format('{{:,}}', round(min_value)::bigint)) AS min_text,
  concat('$', format('{{:,}}', round(avg_value)::bigint)) AS avg_text,
  concat('$', format('{{:,}}', round(max_value)::bigint)) AS max_text
FROM ({MATRIX_SQL}) m""")
def bucket_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).select(
        "l_returnflag", "bucket", "total_listings",
        position_in(F.col("bucket"), BUCKETS).cast("long").alias("bucket_order"),
        dollars(F.col("min_value"), 0).alias("min_text"), dollars(F.col("avg_value"), 0).alias("avg_text"),
        dollars(F.col("max_value"), 0).alias("max_text"))


@query(f"""
SELECT bucket, max(CASE WHEN l_returnflag = 'A' THEN total_listings END) AS a,
  max(CASE WHEN l_returnflag = 'N' THEN total_listings END) AS n,
  max(CASE WHEN l_returnflag = 'R' THEN total_listings END) AS r FROM ({MATRIX_SQL}) m GROUP BY bucket""")
def bucket_matrix_pivot(spark, sf_dir):
    wide = reports.pivot_matrix(_matrix(spark, sf_dir), "l_returnflag", ["A", "N", "R"], "total_listings")
    return wide.withColumnsRenamed({"A": "a", "N": "n", "R": "r"})
