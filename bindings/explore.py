"""Joins of the views and exploration operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import query, table
from hirelake.operators import explore
from hirelake.operators.joins import links_of, multi_hot, term_vocabulary, top_terms, with_dimensions


@query("""
SELECT o_orderkey, o_totalprice, c_name, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON n_nationkey = CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_nationkey END""")
def wide_view(spark, sf_dir):
    """Facts, a required and an optional dimension."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), "c_name", "c_mktsegment",
                                                        "c_nationkey")
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("location_id"), "n_name")
    facts = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("company_id"))
    placed = with_dimensions(facts, {"company_id": customers}).withColumn(
        "location_id", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey")))
    return with_dimensions(placed, optional={"location_id": places}).select(
        "o_orderkey", "o_totalprice", "c_name", "c_mktsegment", "n_name")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def skill_semi_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    chosen = explore.apply_facets(table(spark, sf_dir, "orders"), {"o_orderstatus": "F"})
    return links_of(lines, chosen.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")


@query("""SELECT p_brand AS skill_name, count(*) AS frequency FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_type = 'ECONOMY' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
GROUP BY 1 ORDER BY frequency DESC, skill_name LIMIT 15""")
def top15_skills_filtered(spark, sf_dir):
    """Most frequent skills of one type over the filtered postings."""
    links = _links(spark, sf_dir)
    chosen = explore.apply_facets(table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "All"})
    wanted = links_of(links.filter(F.col("skill_category") == "ECONOMY"),
                      chosen.select(F.col("o_orderkey").alias("job_id")))
    return top_terms(wanted, "skill_name", 15)


def _links(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("skill_name"),
                                                F.col("p_type").alias("skill_category"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_partkey")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("job_id", "skill_name", "skill_category")


@query("""SELECT p_name AS skill_name, count(*) AS freq FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  JOIN part ON l_partkey = p_partkey WHERE o_orderpriority = '2-HIGH' GROUP BY 1 ORDER BY freq DESC, skill_name LIMIT 8""")
def recommended_terms(spark, sf_dir):
    postings = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("job_category"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id"))
    skills = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("skill_name"))
    return explore.recommend_terms(postings, links, skills, "2-HIGH", 8)


@query("""SELECT count(*) AS total_postings, count(DISTINCT user_id) AS active_companies,
  round(avg(value), 6) AS avg_value, round(100.0 * count(*) FILTER (event_type = 'click') / count(*), 6) AS remote_share
FROM events""")
def kpi_row(spark, sf_dir):
    row = explore.kpis(table(spark, sf_dir, "events"), "user_id", "value", "event_type", "click")
    return row.withColumns({name: F.round(name, 6) for name in ("avg_value", "remote_share")})


@query("SELECT o_orderpriority, count(*) AS postings FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def frequency(spark, sf_dir):
    return explore.frequency(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("""SELECT event_type, count(*) AS postings, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share
FROM events WHERE event_type IS NOT NULL GROUP BY 1""")
def mode_share(spark, sf_dir):
    shares = explore.frequency(table(spark, sf_dir, "events"), "event_type", share=True)
    return shares.withColumn("share", F.round("share", 6))


@query("""SELECT n_name, count(*) AS postings FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1 ORDER BY postings DESC, n_name LIMIT 15""")
def top15_places(spark, sf_dir):
    placed = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return explore.frequency(placed, "n_name", top=15)


@query("""SELECT DISTINCT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND n_name IS NOT NULL""")
def facet_values(spark, sf_dir):
    """City choices limited by the chosen country."""
    return explore.facet_values(_customers(spark, sf_dir), "n_name", {"r_name": "ASIA", "c_mktsegment": "All"})


def _customers(spark, sf_dir):
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND c_mktsegment = 'MACHINERY'
  AND c_acctbal BETWEEN 2000 AND 5000""")
def facet_filter(spark, sf_dir):
    facets = {"r_name": "EUROPE", "c_mktsegment": "MACHINERY", "n_name": "All"}
    chosen = explore.apply_facets(_customers(spark, sf_dir), facets, "mid", "c_acctbal", (2000, 5000))
    return chosen.select("c_custkey", "c_name", "c_acctbal")


@query("""SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'th[aei]n|queque|der\\s+s')
  OR regexp_matches(lower(source), 'th[aei]n|queque|der\\s+s')""")
def regex_search(spark, sf_dir):
    found = explore.search(table(spark, sf_dir, "documents"), r"TH[aei]n|QueQue|der\s+s", ("text", "source"))
    return found.select("doc_id")


@query("""
WITH b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders)
SELECT cast(least(floor((o_totalprice - lo) / w), 19) AS int) AS bin, round(min(lo + w * least(floor((o_totalprice - lo) / w), 19)), 4) AS bin_from,
  round(min(lo + w * (least(floor((o_totalprice - lo) / w), 19) + 1)), 4) AS bin_to, count(*) AS postings
FROM orders, b WHERE o_totalprice IS NOT NULL GROUP BY 1""")
def histogram20(spark, sf_dir):
    bins = explore.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 20)
    return bins.withColumns({name: F.round(name, 4) for name in ("bin_from", "bin_to")})


BOX = """
WITH q AS (SELECT {group} AS g, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS q2,
  quantile_cont({value}, 0.75) AS q3 FROM {table} WHERE {value} IS NOT NULL GROUP BY 1),
f AS (SELECT *, q1 - (q3 - q1) * 1.5 AS lo, q3 + (q3 - q1) * 1.5 AS hi FROM q)
SELECT {group}, count(*) AS postings, min({value}) AS min_value, round(min(q1), 6) AS q1, round(min(q2), 6) AS median,
  round(min(q3), 6) AS q3, max({value}) AS max_value, round(min(lo), 6) AS lower_fence, round(min(hi), 6) AS upper_fence,
  min(CASE WHEN {value} BETWEEN lo AND hi THEN {value} END) AS whisker_low,
  max(CASE WHEN {value} BETWEEN lo AND hi THEN {value} END) AS whisker_high,
  count(*) FILTER ({value} NOT BETWEEN lo AND hi) AS outliers
FROM {table} JOIN f ON {group} = g WHERE {value} IS NOT NULL GROUP BY 1"""
ROUNDED = ("q1", "median", "q3", "lower_fence", "upper_fence")


@query(BOX.format(group="c_mktsegment", value="c_acctbal", table="customer"))
def box_stats(spark, sf_dir):
    stats = explore.box_stats(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    return stats.withColumns({name: F.round(name, 6) for name in ROUNDED})


@query(BOX.format(group="l_returnflag", value="l_extendedprice", table="lineitem"))
def box_stats_lines(spark, sf_dir):
    stats = explore.box_stats(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return stats.withColumns({name: F.round(name, 6) for name in ROUNDED})


@query("""SELECT o_orderkey, c_mktsegment, o_totalprice, c_acctbal, coalesce(CASE WHEN c_acctbal > 3000 THEN o_totalprice END, c_acctbal + 2) AS point_size
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal IS NOT NULL AND o_totalprice IS NOT NULL""")
def scatter_points(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.withColumn("years_max", F.when(F.col("c_acctbal") > 3000, F.col("o_totalprice")))
    return explore.scatter_points(joined, "c_acctbal", "years_max", "o_totalprice", ("o_orderkey", "c_mktsegment"))


TOP20 = """top AS (SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
  ORDER BY n DESC, p_brand LIMIT 20)"""


@query(f"WITH {TOP20} SELECT p_brand AS skill_name, n AS frequency FROM top")
def top20_terms(spark, sf_dir):
    return top_terms(_links(spark, sf_dir), "skill_name", 20)


@query(f"""WITH {TOP20}
SELECT o_orderkey AS job_id, p_brand AS skill, cast(CASE WHEN EXISTS (SELECT 1 FROM lineitem JOIN part p ON l_partkey = p.p_partkey
  WHERE l_orderkey = o_orderkey AND p.p_brand = top.p_brand) THEN 1 ELSE 0 END AS int) AS flag FROM orders, top""")
def top20_flags(spark, sf_dir):
    """0/1 flag per posting and frequent skill, in long form."""
    links = _links(spark, sf_dir)
    terms = term_vocabulary(links, "skill_name", 20)
    postings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    wide = multi_hot(postings, links, terms)
    entry = F.explode(F.array(*[
        F.struct(F.lit(term).alias("skill"), F.col(f"`skill_{term}`").alias("flag")) for term in terms])).alias("e")
    return wide.select("job_id", entry).select("job_id", "e.skill", "e.flag")
