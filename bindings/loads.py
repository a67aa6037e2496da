"""Loads that repeat, stream and mix formats, the order of reports, and models that are filtered for, saved and scored."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from bindings.registry import postings, query, table
from bindings.star import _star_tags, loaded_star
from bindings.transforms import CHECKED, MODE, RAW, ROLE
from hirelake import rules
from hirelake.operators import models
from hirelake.operators.keys import number_rows
from hirelake.operators.load import load_star
from hirelake.operators.transform import check_records
from hirelake.plans import reports as star_reports
from hirelake.plans.jobs import train
from hirelake.plans.views import MODEL_COLUMNS, skill_links, wide_view
from hirelake.session import settle, shared_folder
from hirelake.sources.lake import read_lake, record_fields
from hirelake.sources.star import Star
from hirelake.streaming.incremental import run_incremental

DAY = dt.date(2026, 1, 2)
DAYS = 9
_STARS: dict[tuple, Star] = {}

# A posting for each customer: its day, category and name depend on the row.
CUSTOMER = """SELECT c_custkey, c_custkey % 9 AS day, CASE c_custkey % 4 WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Chef ' || c_mktsegment
  WHEN 2 THEN 'Web Developer' ELSE ' ' END AS title, c_name AS company FROM customer"""
CUSTOMER_ROLE = "CASE c_custkey % 4 WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Other' ELSE 'Software Engineer' END"


def customer_postings(spark, sf_dir):
    return table(spark, sf_dir, "customer").repartitionByRange("c_custkey").selectExpr(
        "c_custkey", "cast(c_custkey % 9 AS int) AS day", """CASE c_custkey % 4 WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Chef ' || c_mktsegment
        WHEN 2 THEN 'Web Developer' ELSE ' ' END AS title""", "c_name AS company")


def customer_records(rows):
    named = rows.selectExpr("'customer' AS file", "c_custkey AS ordinal", "to_json(struct(title, company)) AS raw")
    return named.select("file", "ordinal", record_fields("raw").alias("fields"), "raw")


def dated_star(spark, sf_dir) -> Star:
    """Nine loads on nine days, the fifth of them twice under its name, once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STARS:
        star, rows = Star(spark, shared_folder(spark, "dated-star")), customer_postings(spark, sf_dir)
        for day in (*range(DAYS), 4):
            load_star(check_records(customer_records(rows.filter(F.col("day") == day))), star, DAY + dt.timedelta(days=day), f"day {day}")
        _STARS[key] = star
    return _STARS[key]


@query(f"""WITH p AS ({CUSTOMER}), d AS (SELECT {CUSTOMER_ROLE} AS c, DATE '2026-01-02' + cast(day AS int) AS t, count(*) AS n
  FROM p WHERE trim(title) <> '' GROUP BY ALL)
SELECT c AS "Job Category", t AS "Posted Date", n AS "Daily Postings", round(avg(n) OVER w, 2) AS "7D Rolling Avg Postings",
  count(*) OVER w AS "Days in Window" FROM d WINDOW w AS (PARTITION BY c ORDER BY t ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def dated_posting_volume(spark, sf_dir):
    """Daily postings and their rolling average over nine load dates."""
    return star_reports.posting_volume(dated_star(spark, sf_dir))


@query(f"""WITH p AS ({CUSTOMER}) SELECT 'day ' || day AS load_id, count(*) AS records_read, count(*) FILTER (trim(title) <> '') AS inserted,
  count(*) FILTER (trim(title) = '') AS skipped, count(*) FILTER (trim(title) <> '') AS postings, count(*) FILTER (trim(title) <> '') AS job_ids,
  count(*) FILTER (trim(title) = '') AS set_aside, min(CASE WHEN trim(title) = '' THEN '{{"title":" ","company":"' || company || '"}}' END) AS raw FROM p GROUP BY ALL""")
def repeat_load(spark, sf_dir):
    """A load that is repeated under its name replaces itself: log, postings, ids and set-aside rows of each load."""
    star = dated_star(spark, sf_dir).snapshot()
    shown = star.stored("job_postings").groupBy("load_id").agg(F.count("*").alias("postings"), F.count_distinct("job_id").alias("job_ids"))
    aside = star.stored("quarantine").groupBy("load_id").agg(F.count("*").alias("set_aside"), F.min("raw").alias("raw"))
    return (star.stored("load_log").select("load_id", "records_read", "inserted", "skipped").join(shown, "load_id").join(aside, "load_id", "left")
            .withColumn("set_aside", F.coalesce("set_aside", F.lit(0).cast("long"))))


@query(f"""WITH p AS ({CUSTOMER}), k AS (SELECT * FROM p WHERE trim(title) <> '')
SELECT count(*) AS postings, count(DISTINCT company) AS companies, cast(1 AS bigint) AS first_id, count(*) AS last_id, count(*) AS ids,
  cast(5 AS bigint) AS tables, cast(0 AS bigint) AS left_over FROM k""")
def compacted_star(spark, sf_dir):
    """The dated star after compaction: the same rows, one live partition in each table that has any (no posting has a place
    or a skill), no log entry left in the state."""
    star = dated_star(spark, sf_dir)
    star.compact()
    state = star.current()[1]
    one = sum(len(names) == 1 for names in state["live"].values())
    return star.table("job_postings").agg(
        F.count("*").alias("postings"), F.count_distinct("company_id").alias("companies"), F.min("job_id").alias("first_id"),
        F.max("job_id").alias("last_id"), F.count_distinct("job_id").alias("ids")).select(
            "*", F.lit(one).cast("long").alias("tables"), F.lit(len(state["loads"])).cast("long").alias("left_over"))


@query(f"""WITH p AS ({CUSTOMER}), k AS (SELECT c_custkey % 2 AS stream, * FROM p WHERE trim(title) <> '')
SELECT count(*) AS postings, count(DISTINCT company) AS companies, count(DISTINCT c_custkey % 2) AS loads,
  count(*) AS job_ids, max(rank) AS last_id FROM (SELECT *, row_number() OVER () AS rank FROM k)""")
def two_streams(spark, sf_dir):
    """Two lakes, each with a stream and checkpoint of its own, into one star; both run again without new files."""
    rows, root = customer_postings(spark, sf_dir), shared_folder(spark, "two-streams-star")
    lakes = [shared_folder(spark, f"lake-{i}") for i in range(2)]
    for i, lake in enumerate(lakes):
        rows.filter(F.col("c_custkey") % 2 == i).select("title", "company").coalesce(1).write.json(lake)
    for i, lake in [*enumerate(lakes), *enumerate(lakes)]:
        run_incremental(spark, lake, root, f"{root}-mark-{i}", DAY)
    shown = Star(spark, root).stored("job_postings")
    return shown.agg(F.count("*").alias("postings"), F.count_distinct("company_id").alias("companies"),
                     F.count_distinct("load_id").alias("loads"), F.count_distinct("job_id").alias("job_ids"), F.max("job_id").alias("last_id"))


def _mixed_lake(spark, sf_dir, label: str) -> str:
    """A folder with a dot in its name: a third of the postings as JSON Lines, a third as CSV, the rest under a suffix
    that no lake file has."""
    path = shared_folder(spark, label) + ".v1"
    rows = postings(spark, sf_dir).select("id", "title", F.col("company").alias("Company"), F.col("place").alias(" LOCATION "), "description")
    third = [rows.filter(F.col("id") % 3 == i).drop("id") for i in range(3)]
    third[0].write.json(f"{path}/json")
    third[1].select("description", "title", " LOCATION ", "Company").write.option("header", True).option("escape", '"').csv(f"{path}/csv")
    third[2].select(F.to_json(F.struct("*"))).write.text(f"{path}/other")
    return path


MIXED = RAW + f""", k AS (SELECT id % 3 AS kind, {ROLE} AS job_category, {MODE} AS is_remote, trim(title) AS title,
  CASE WHEN trim(place) <> '' THEN trim(string_split(trim(place), ',')[1]) END AS city FROM raw WHERE id % 3 < 2)"""


@query(MIXED + " SELECT CASE kind WHEN 0 THEN 'json' ELSE 'csv' END AS kind, job_category, city, count(*) AS records FROM k GROUP BY ALL")
def mixed_folder(spark, sf_dir):
    """Batch scan of a folder of several formats; files with another suffix are left alone."""
    records = check_records(read_lake(spark, _mixed_lake(spark, sf_dir, "mixed-folder")))
    return records.groupBy(F.regexp_extract("file", r"\.(\w+)$", 1).alias("kind"), "job_category", "city").agg(F.count("*").alias("records"))


@query(MIXED + " SELECT job_category, is_remote, city, count(*) AS postings FROM k WHERE title <> '' GROUP BY ALL")
def mixed_drops(spark, sf_dir):
    """A stream over files of several formats, each routed by its suffix and read with its own header."""
    root = shared_folder(spark, "mixed-star")
    run_incremental(spark, _mixed_lake(spark, sf_dir, "mixed-drops"), root, f"{root}-mark", DAY)
    view = wide_view(Star(spark, root), ("job_category", "is_remote", "city"))
    folded = view.withColumn("city", F.upper("city"))  # a place is kept in its first spelling
    return folded.groupBy("job_category", "is_remote", "city").agg(F.count("*").alias("postings"))


# ---- the order of the reports: the sort keys at each place, so that ties cannot differ ---------------------------------

@query(CHECKED + """, s AS (SELECT job_category, country, city, count(*) AS n, cast(sum(salary_mid_usd) * 100 AS bigint) AS c
  FROM checked WHERE reason IS NULL AND city IS NOT NULL AND salary_mid_usd IS NOT NULL GROUP BY ALL),
r AS (SELECT job_category, country, dense_rank() OVER (PARTITION BY job_category, country ORDER BY (2 * c + n) // (2 * n) DESC) AS k FROM s),
v AS (SELECT DISTINCT job_category FROM checked WHERE reason IS NULL),
m AS (SELECT is_remote, CASE WHEN experience_min < 2 THEN 1 WHEN experience_min BETWEEN 2 AND 5 THEN 2 WHEN experience_min > 5 THEN 3 ELSE 4 END AS b
  FROM checked WHERE reason IS NULL AND salary_mid_usd IS NOT NULL GROUP BY ALL)
SELECT 'place rank' AS report, row_number() OVER (ORDER BY job_category, country NULLS FIRST, k) AS position,
  job_category AS first_key, country AS second_key, cast(k AS varchar) AS third_key FROM r
UNION ALL SELECT 'volume', row_number() OVER (ORDER BY job_category), job_category, '2026-01-02', NULL FROM v
UNION ALL SELECT 'matrix', row_number() OVER (ORDER BY is_remote, b), is_remote, CASE b WHEN 1 THEN 'Entry-Level (<2 yrs)' WHEN 2 THEN 'Mid-Level (2-5 yrs)'
  WHEN 3 THEN 'Senior-Level (>5 yrs)' ELSE 'Not Specified' END, NULL FROM m""")
def report_order(spark, sf_dir):
    """Three reports in the order in which they are handed over, numbered as written."""
    star = loaded_star(spark, sf_dir)
    listed = []
    for name, report, keys in (
            ("place rank", star_reports.location_salary_rank(star), ("Job Category", "Country", "Salary Rank")),
            ("volume", star_reports.posting_volume(star), ("Job Category", "Posted Date")),
            ("matrix", star_reports.compensation_matrix(star), ("Work Mode", "Experience Bucket"))):
        columns = [F.col(k).cast("string").alias(f"{n}_key") for n, k in zip(("first", "second", "third"), (*keys, None)) if k]
        placed = number_rows(settle(report.select(*columns), "report"), "position").withColumn("report", F.lit(name))
        listed.append(placed if len(keys) == 3 else placed.withColumn("third_key", F.lit(None).cast("string")))
    first, *rest = (p.select("report", "position", "first_key", "second_key", "third_key") for p in listed)
    for more in rest:
        first = first.unionByName(more)
    return first


@query(_star_tags() + """, f AS (SELECT job_category, term_type, term, count(*) AS n FROM tagged GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY job_category, term_type ORDER BY n DESC, term) AS k FROM f)
SELECT row_number() OVER (ORDER BY job_category, term_type, k) AS position, job_category, term_type AS skill_type, term AS skill FROM r WHERE k <= 5""")
def top_skill_order(spark, sf_dir):
    report = star_reports.top_skills(loaded_star(spark, sf_dir)).select(
        F.col("Job Category").alias("job_category"), F.col("Skill Type").alias("skill_type"), F.col("Skill Name").alias("skill"))
    return number_rows(settle(report, "report"), "position")


# ---- models -------------------------------------------------------------------------------------------------------------

@query("SELECT c_custkey, c_mktsegment AS label FROM customer WHERE c_custkey % 3 = 2")
def label_filter(spark, sf_dir):
    """Rows with a usable label: neither null nor empty."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE c_custkey % 3 WHEN 0 THEN '' WHEN 2 THEN c_mktsegment END AS label")
    return models.labelled(rows, "label")


@query("SELECT c_custkey, c_acctbal AS target FROM customer WHERE c_custkey % 5 <> 0 AND c_acctbal > 0")
def target_filter(spark, sf_dir):
    """Rows with a usable target: given and above zero."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS target")
    return models.usable_targets(rows, "target")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS a, c_nationkey AS n, c_custkey % 2 AS flag,
  CASE WHEN c_custkey % 11 > 0 THEN c_mktsegment END AS s FROM customer),
f AS (SELECT c_custkey, flag, n, coalesce(a, (SELECT median(a) FROM c)) AS a,
  coalesce(s, (SELECT s FROM c WHERE s IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 1)) AS s FROM c)
SELECT c_custkey, round((a - avg(a) OVER ()) / stddev_samp(a) OVER (), 6) AS balance, round((n - avg(n) OVER ()) / stddev_samp(n) OVER (), 6) AS nation,
  cast(dense_rank() OVER (ORDER BY s) AS int) AS hot, cast(1 AS double) AS ones, cast(flag AS double) AS flag,
  (SELECT count(DISTINCT s) FROM f)::int + 3 AS width FROM f""")
def salary_features(spark, sf_dir):
    """Imputed, scaled, encoded and assembled features: two numbers, one category, one flag."""
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS balance", "c_nationkey AS nation",
        "CASE WHEN c_custkey % 11 > 0 THEN c_mktsegment END AS segment", "cast(c_custkey % 2 AS int) AS flag")
    fill = models.fit_fill_values(rows, ["balance", "nation"], ["segment"])
    stages = models.salary_stages(fill, ["flag"], ["balance", "nation"], ["segment"])
    v = Pipeline(stages=stages).fit(rows).transform(rows).select("c_custkey", vector_to_array("salary_features").alias("v"))
    hot = F.slice("v", 3, F.size("v") - 3)
    return v.select("c_custkey", F.round(F.col("v")[0], 6).alias("balance"), F.round(F.col("v")[1], 6).alias("nation"),
                    F.array_position(hot, F.lit(1.0)).cast("int").alias("hot"), F.aggregate(hot, F.lit(0.0), lambda a, x: a + x).alias("ones"),
                    F.element_at("v", -1).alias("flag"), F.size("v").alias("width"))


_MODELS: dict[tuple, tuple] = {}
SMALL = {"trees": 5, "depth": 4}  # small forests: these queries are about saving and scoring


def _trained(spark, sf_dir):
    """(report of the training job, model folder, star)"""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        star, path = loaded_star(spark, sf_dir), shared_folder(spark, "models")
        _MODELS[key] = (train(spark, star.root, path, **SMALL), path, star)
    return _MODELS[key]


def _requests(star):
    return wide_view(star, MODEL_COLUMNS).select("job_id", "title", "description", "country", "is_remote", "experience_min", "experience_max")


NAMED = "named AS (SELECT row_number() OVER () AS job_id FROM checked WHERE reason IS NULL)"


@query(CHECKED + f", {NAMED} SELECT job_id, true AS known, 0.85::double AS low, 1.15::double AS high, true AS above_zero FROM named")
def score_band(spark, sf_dir):
    """All postings as requests: a category that exists, a salary from it and the band around the salary."""
    report, _, star = _trained(spark, sf_dir)
    scored = models.score_postings(report["category_model"], report["salary_model"], _requests(star))
    labels = [label for label, _ in rules.ROLE_RULES] + [rules.ROLE_DEFAULT]
    return scored.select("job_id", F.col("job_category").isin(labels).alias("known"), F.round(F.col("salary_low") / F.col("predicted_salary"), 9).alias("low"),
                         F.round(F.col("salary_high") / F.col("predicted_salary"), 9).alias("high"), (F.col("predicted_salary") > 0).alias("above_zero"))


@query(CHECKED + f", {NAMED} SELECT job_id, true AS same FROM named")
def model_reload(spark, sf_dir):
    """Models as fitted and as loaded from their folder score every posting alike; a folder without models has none."""
    report, path, star = _trained(spark, sf_dir)
    category, salary = models.load_models(spark, path)
    none = models.load_models(spark, f"{path}/nothing-here") == (None, None)
    ours = models.score_postings(report["category_model"], report["salary_model"], _requests(star)).select("job_id", "job_category", "predicted_salary")
    theirs = models.score_postings(category, salary, _requests(star)).select("job_id", F.col("job_category").alias("c"), F.col("predicted_salary").alias("s"))
    same = (F.col("c") == F.col("job_category")) & (F.col("s") == F.col("predicted_salary")) & F.lit(none and salary[1] == report["salary_model"][1])
    return ours.join(theirs, "job_id").select("job_id", same.alias("same"))


@query(_star_tags() + """, g AS (SELECT * FROM checked WHERE reason IS NULL)
SELECT (SELECT cast(ceil(round(count(*) * 0.2, 9)) AS bigint) FROM g) AS tested, (SELECT count(DISTINCT job_category) FROM g) AS classes,
  (SELECT cast(ceil(round(count(*) * 0.2, 9)) AS bigint) FROM g WHERE salary_mid_usd > 0) AS salaries_tested,
  (SELECT cast(least(20, count(DISTINCT term)) AS int) FROM tagged) AS skills, true AS better_than_most_frequent""")
def train_job(spark, sf_dir):
    """The training job: rows that both models are tested on, classes, skill vocabulary, and an accuracy above that of
    always naming the most frequent class."""
    report, _, star = _trained(spark, sf_dir)
    most = star.table("job_postings").groupBy("job_category").count().agg((F.max("count") / F.sum("count")).alias("share")).scalar()
    weighted = report["classes"].filter("class = 'weighted avg'").select("support").scalar()
    classes = report["classes"].filter("class NOT IN ('macro avg', 'weighted avg')").agg(F.count("*")).scalar()
    return report["accuracy"].select(
        weighted.alias("tested"), classes.alias("classes"), report["regression"].select("rows").scalar().alias("salaries_tested"),
        F.lit(len(report["salary_model"][1])).alias("skills"), (F.col("accuracy") > most).alias("better_than_most_frequent"))
