"""Dimensions, the star load, integrity and the reports over the loaded star."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bindings.registry import posting_documents, posting_records, query, table
from bindings.transforms import CHECKED, MONEY_AS_DOUBLE, MONEY_COLUMNS
from hirelake.operators import integrity
from hirelake.operators.keys import attach_id, insert_ignore, resolve_dim
from hirelake.operators.load import load_star
from hirelake.operators.transform import check_records
from hirelake.plans import reports as star_reports
from hirelake.plans.views import display_list, skill_links, wide_view
from hirelake.session import shared_folder
from hirelake.sources.star import SCHEMAS, Star, align_to_schema
from hirelake.streaming.incremental import run_incremental

LOAD_DATE = dt.date(2026, 1, 2)
_LOADED: dict[tuple, Star] = {}


def loaded_star(spark, sf_dir) -> Star:
    """The star loaded from the derived postings, once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LOADED:
        star = Star(spark, shared_folder(spark, "star"))
        load_star(check_records(posting_records(spark, sf_dir)), star, LOAD_DATE, "first")
        _LOADED[key] = star
    return _LOADED[key]


NAME = """CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment
  WHEN 2 THEN replace(c_mktsegment, 'U', 'Ú') ELSE c_name END"""


@query(f"""
WITH n AS (SELECT c_custkey, {NAME} AS name FROM customer),
f AS (SELECT strip_accents(lower(name)) AS k, min(c_custkey) AS first_seen, min_by(name, c_custkey) AS company_name
  FROM n GROUP BY 1)
SELECT row_number() OVER (ORDER BY first_seen) AS company_id, company_name FROM f""")
def company_dim(spark, sf_dir):
    """Get-or-create of names that differ in case and accents: first spelling, ids in order of appearance."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(NAME).alias("company_name"))
    empty = spark.createDataFrame([], "company_id long, company_name string")
    return resolve_dim(rows, empty, ["company_name"], "company_id", "c_custkey")[0]


PLACE = """CASE c_custkey % 3 WHEN 0 THEN upper(n_name) ELSE lower(n_name) END AS city,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS region, CASE WHEN n_regionkey = 1 THEN NULL ELSE 'C' || n_regionkey END AS country"""


@query(f"""
WITH p AS (SELECT c_custkey, {PLACE} FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT lower(city) AS c, lower(region) AS r, lower(country) AS l, min(c_custkey) AS first_seen FROM p GROUP BY ALL),
d AS (SELECT *, row_number() OVER (ORDER BY first_seen) + 100 AS location_id FROM k)
SELECT c_custkey, location_id FROM p JOIN d ON lower(city) = c AND lower(region) IS NOT DISTINCT FROM r
  AND lower(country) IS NOT DISTINCT FROM l""")
def location_dim(spark, sf_dir):
    """Null-safe place keys resolved back onto the rows; ids continue after the highest known one."""
    rows = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).selectExpr("c_custkey", *[part.strip() for part in PLACE.replace("END AS region,", "END AS region;").replace(
        "END AS city,", "END AS city;").split(";")])
    known = spark.createDataFrame([(100, "Elsewhere", None, None)],
                                  "location_id long, city string, region string, country string")
    keys = ["city", "region", "country"]
    _, mapping = resolve_dim(rows, known, keys, "location_id", "c_custkey")
    return attach_id(rows, mapping, keys).select("c_custkey", "location_id")


@query("""
WITH t AS (SELECT event_id, event_type AS skill_name, CASE WHEN value > 5 THEN 'technical' ELSE 'soft' END AS skill_category
  FROM events),
f AS (SELECT skill_name, min(event_id) AS s, min_by(skill_category, event_id) AS skill_category FROM t GROUP BY 1)
SELECT row_number() OVER (ORDER BY s) AS skill_id, skill_name, skill_category FROM f""")
def skill_dim(spark, sf_dir):
    """The type of a skill is fixed by its first row."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("skill_name"),
        F.when(F.col("value") > 5, "technical").otherwise("soft").alias("skill_category"))
    empty = spark.createDataFrame([], "skill_id long, skill_name string, skill_category string")
    return resolve_dim(rows, empty, ["skill_name"], "skill_id", "event_id", keep=["skill_category"])[0]


@query("""
SELECT DISTINCT l_orderkey AS job_id, l_partkey AS skill_id FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM lineitem e WHERE e.l_returnflag = 'R' AND e.l_orderkey = l.l_orderkey
  AND e.l_partkey = l.l_partkey)""")
def bridge_insert_ignore(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    links = lines.select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id"))
    existing = lines.filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id"))
    return insert_ignore(links, existing)


@query("""SELECT c_custkey AS location_id, c_name AS city, NULL::varchar AS region, 'India' AS country FROM customer""")
def schema_alignment(spark, sf_dir):
    """Additive schema change: a missing column gets its default, or null."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("city"), F.col("c_custkey").alias("location_id"))
    return align_to_schema(rows, SCHEMAS["locations"], {"country": "India"})


@query("""
SELECT 'orders key repeats' AS rule, count(*) AS violations FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'lineitem key repeats', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'part names repeat', count(*) FROM (SELECT lower(p_name) FROM part GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'lineitem without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'document without label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'unknown language', count(*) FROM documents WHERE lang NOT IN ('en', 'de')
UNION ALL SELECT 'text missing', count(*) FROM documents WHERE text IS NULL""")
def integrity_report(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    return integrity.report(
        integrity.duplicate_keys(t("orders"), ["o_orderkey"], "orders key repeats"),
        integrity.duplicate_keys(t("lineitem"), ["l_orderkey", "l_linenumber"], "lineitem key repeats"),
        integrity.duplicate_keys(t("part"), ["p_name"], "part names repeat", "UNICODE_CI_AI"),
        integrity.orphans(t("lineitem"), t("orders"), "l_orderkey", "lineitem without order", "o_orderkey"),
        integrity.orphans(t("documents"), t("labels"), "doc_id", "document without label"),
        integrity.outside_domain(t("documents"), "lang", ("en", "de"), "unknown language"),
        integrity.missing_values(t("documents"), "text", "text missing"),
    )


WIDE = ("title", "description", "company_name", "city", "region", "country", "salary_min", "salary_max",
        "experience_min", "experience_max", "job_category", "is_remote", "salary_currency", "salary_min_usd",
        "salary_max_usd", "salary_mid_usd", "posted_date")
FIRST_COMPANY = """, named AS (SELECT *, lower(company_name) AS company_key FROM checked WHERE reason IS NULL)"""


@query(CHECKED + FIRST_COMPANY + f"""
SELECT title, description, company_key, city, region, CASE WHEN city IS NULL THEN NULL ELSE country END AS country,
  {MONEY_AS_DOUBLE}, experience_min, experience_max, job_category, is_remote, salary_currency,
  DATE '2026-01-02' AS posted_date FROM named""")
def star_wide_view(spark, sf_dir):
    """Postings loaded into the star and joined back to their dimensions (company in lower case, because the
    dimension keeps whichever spelling came first)."""
    view = wide_view(loaded_star(spark, sf_dir), WIDE)
    return view.withColumns({name: F.col(name).cast("double") for name in MONEY_COLUMNS}).withColumn(
        "company_key", F.lower("company_name")).drop("company_name")


@query(CHECKED + FIRST_COMPANY + """
SELECT (SELECT count(*) FROM named) AS postings, (SELECT count(DISTINCT company_key) FROM named) AS companies,
  (SELECT count(*) FROM (SELECT DISTINCT city, region, country FROM named WHERE city IS NOT NULL)) AS locations,
  1 AS first_job_id, (SELECT count(*) FROM named) AS last_job_id, (SELECT count(*) FROM named) AS distinct_job_ids""")
def star_keys(spark, sf_dir):
    """Surrogate keys are dense and unique, dimensions hold each natural key once."""
    star = loaded_star(spark, sf_dir)
    keys = star.table("job_postings").agg(
        F.count(F.lit(1)).alias("postings"), F.min("job_id").cast("int").alias("first_job_id"),
        F.max("job_id").alias("last_job_id"), F.count_distinct("job_id").alias("distinct_job_ids"))
    return keys.select(
        "postings", star.table("companies").agg(F.count_distinct("company_id").alias("n")).scalar().alias("companies"),
        star.table("locations").agg(F.count_distinct("location_id").alias("n")).scalar().alias("locations"),
        "first_job_id", "last_job_id", "distinct_job_ids")


# The average is rounded half up on whole cents, because DuckDB averages decimals as doubles and loses exact ties.
@query(CHECKED + """, s AS (SELECT job_category, country, city, count(*) AS n, cast(sum(salary_mid_usd) * 100 AS bigint) AS c
  FROM checked WHERE reason IS NULL AND city IS NOT NULL AND salary_mid_usd IS NOT NULL GROUP BY ALL),
g AS (SELECT *, (2 * c + n) // (2 * n) AS cents FROM s)
SELECT job_category AS "Job Category", country AS "Country", city AS "City", n AS "Postings Count",
  '$' || format('{:,.2f}', cents / 100.0) AS "Average Midpoint Salary (USD)",
  cast(dense_rank() OVER (PARTITION BY job_category, country ORDER BY cents DESC) AS int) AS "Salary Rank" FROM g""")
def star_location_salary_rank(spark, sf_dir):
    return star_reports.location_salary_rank(loaded_star(spark, sf_dir))


@query(CHECKED + """SELECT job_category AS "Job Category", DATE '2026-01-02' AS "Posted Date", count(*) AS "Daily Postings",
  cast(count(*) AS double) AS "7D Rolling Avg Postings", cast(1 AS bigint) AS "Days in Window"
FROM checked WHERE reason IS NULL GROUP BY job_category""")
def star_posting_volume(spark, sf_dir):
    return star_reports.posting_volume(loaded_star(spark, sf_dir))


def _star_tags() -> str:
    from bindings.transforms import _tag_sql
    from hirelake.rules import default_terms

    return CHECKED + ", tagged AS (" + _tag_sql(
        "(SELECT id, job_category, title || ' ' || description AS t FROM checked WHERE reason IS NULL)",
        "id, job_category", "t", default_terms()) + ")\n"


@query(_star_tags() + """, f AS (SELECT job_category, term_type, term, count(*) AS n FROM tagged GROUP BY ALL),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY job_category, term_type ORDER BY n DESC, term) AS int) AS k FROM f)
SELECT job_category AS "Job Category", term_type AS "Skill Type", term AS "Skill Name", n AS "Job Count", k AS "Rank"
FROM r WHERE k <= 5""")
def star_top_skills(spark, sf_dir):
    return star_reports.top_skills(loaded_star(spark, sf_dir))


@query(_star_tags() + "SELECT term AS skill_name, term_type AS skill_category, count(*) AS links FROM tagged GROUP BY ALL")
def star_skill_links(spark, sf_dir):
    return skill_links(loaded_star(spark, sf_dir)).groupBy("skill_name", "skill_category").agg(
        F.count(F.lit(1)).alias("links"))


@query(CHECKED + """SELECT is_remote AS "Work Mode", CASE WHEN experience_min < 2 THEN 'Entry-Level (<2 yrs)'
    WHEN experience_min BETWEEN 2 AND 5 THEN 'Mid-Level (2-5 yrs)' WHEN experience_min > 5 THEN 'Senior-Level (>5 yrs)'
    ELSE 'Not Specified' END AS "Experience Bucket", count(*) AS "Total Listings",
  concat('$', format('{:,}', round(min(salary_min_usd))::bigint)) AS "Min Salary (USD)",
  concat('$', format('{:,}', round(avg(salary_mid_usd))::bigint)) AS "Avg Midpoint Salary (USD)",
  concat('$', format('{:,}', round(max(salary_max_usd))::bigint)) AS "Max Salary (USD)"
FROM checked WHERE reason IS NULL AND salary_mid_usd IS NOT NULL GROUP BY 1, 2""")
def star_compensation_matrix(spark, sf_dir):
    return star_reports.compensation_matrix(loaded_star(spark, sf_dir))


@query(CHECKED + FIRST_COMPANY + """SELECT title AS "Job Title", company_key AS "Company", city AS "City",
  CASE WHEN city IS NULL THEN NULL ELSE country END AS "Country", job_category AS "Category", is_remote AS "Mode",
  experience_min AS "Min Exp (Yrs)", salary_currency AS "Currency", cast(salary_min AS double) AS "Min Salary",
  cast(salary_max AS double) AS "Max Salary", DATE '2026-01-02' AS "Posted Date" FROM named""")
def star_display_list(spark, sf_dir):
    shown = display_list(wide_view(loaded_star(spark, sf_dir)))
    return shown.withColumns({"Company": F.lower("Company"), "Min Salary": F.col("Min Salary").cast("double"),
                              "Max Salary": F.col("Max Salary").cast("double")})


@query(CHECKED + "SELECT 'orders' AS file, id AS ordinal, reason, title FROM checked WHERE reason IS NOT NULL")
def star_quarantine(spark, sf_dir):
    """Rows that the load did not take, by file, place and reason."""
    return loaded_star(spark, sf_dir).table("quarantine").select("file", "ordinal", "reason", "title")


@query("SELECT c_custkey AS location_id, c_mktsegment AS city, CASE WHEN c_custkey % 2 = 0 THEN 'India' ELSE 'C' || c_nationkey END AS country FROM customer")
def schema_change(spark, sf_dir):
    """Rows stored before a column existed read its default, newer ones their own value."""
    star = Star(spark, shared_folder(spark, "changed-star"))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("location_id"), F.col("c_mktsegment").alias("city"), F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("country"))
    old = rows.filter("location_id % 2 = 0").drop("country").withColumn("load_id", F.lit("old"))
    old.write.partitionBy("load_id").parquet(star.path("locations"))
    star.write(rows.filter("location_id % 2 = 1"), "locations", "new")
    return star.table("locations").select("location_id", "city", "country")


@query(CHECKED + """SELECT job_category, is_remote, salary_currency, count(*) AS postings,
  count(salary_mid_usd) AS with_salary FROM checked WHERE reason IS NULL GROUP BY ALL""")
def incremental_load(spark, sf_dir):
    """All postings as a lake that arrives in two drops, each loaded by its own run of the stream."""
    lake, root, mark = (shared_folder(spark, name) for name in ("drops", "stream-star", "stream-mark"))
    documents = posting_documents(spark, sf_dir)
    for drop in ("salary_case < 4", "salary_case >= 4"):
        documents.filter(drop).select("doc").write.mode("append").text(lake)
        run_incremental(spark, lake, root, mark, LOAD_DATE, fmt="lines")
    return Star(spark, root).table("job_postings").groupBy("job_category", "is_remote", "salary_currency").agg(
        F.count(F.lit(1)).alias("postings"), F.count("salary_mid_usd").alias("with_salary"))
