"""Loading the star: golden numbers of the raw sample, keys, quarantine, repetition, streaming."""

import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from hirelake.operators.integrity import integrity_report
from hirelake.operators.keys import insert_ignore, number_rows, resolve_dim, sequential_ids
from hirelake.operators.load import load_star
from hirelake.operators.transform import check_records, transform_records
from hirelake.plans import reports
from hirelake.plans.jobs import load_lake
from hirelake.plans.views import DASHBOARD_COLUMNS, MODEL_COLUMNS, display_list, skill_links, wide_view
from hirelake.sources.lake import read_lake
from hirelake.sources.star import SCHEMAS, Star, align_to_schema
from hirelake.streaming.incremental import run_incremental

RAW = os.environ.get("RAW_SAMPLE_DIR", "")  # folder with the 18 raw sample files, if there is one
DAY = dt.date(2026, 7, 5)
needs_raw = pytest.mark.skipif(not RAW or not glob.glob(f"{RAW}/*.json"), reason="RAW_SAMPLE_DIR names no raw sample")


def write_records(folder, name, records):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps(records))


def counts(star):
    return {t: star.table(t).count() for t in ("companies", "locations", "skills", "job_postings", "job_skills")}


@needs_raw
def test_raw_sample(spark, tmp_path):
    root = str(tmp_path / "star")
    log = load_lake(spark, f"{RAW}/*.json", root, DAY, load_id="one").first()
    assert (log.records_read, log.inserted, log.skipped) == (360, 360, 0)
    star = Star(spark, root)
    assert counts(star) == {"companies": 77, "locations": 23, "skills": 52, "job_postings": 360, "job_skills": 494}
    postings = star.table("job_postings")
    by = lambda name: {r[0]: r[1] for r in postings.groupBy(name).count().collect()}
    assert by("job_category") == {"Software Engineer": 324, "Other": 22, "Management": 14}
    assert by("is_remote") == {"Onsite": 339, "Remote": 12, "Hybrid": 9}
    assert postings.filter("experience_min is null").count() == 248
    top = {r.skill_name: r.n for r in skill_links(star).groupBy("skill_name").agg(F.count("*").alias("n")).collect()}
    assert (top["PHP"], top["MySQL"], top["React"], top["React.js"], top["Communication"]) == (41, 37, 25, 25, 9)
    assert all(r.violations == 0 for r in integrity_report(star).collect())
    assert reports.top_skills(star).columns == ["Job Category", "Skill Type", "Skill Name", "Job Count", "Rank"]
    assert reports.compensation_matrix(star).count() > 0 and reports.posting_volume(star).count() == 3
    assert reports.location_salary_rank(star).columns[4] == "Average Midpoint Salary (USD)"
    load_lake(spark, f"{RAW}/*.json", root, DAY, load_id="two")
    assert counts(star) == {"companies": 77, "locations": 23, "skills": 52, "job_postings": 720, "job_skills": 988}
    ids = star.table("job_postings").agg(F.min("job_id"), F.max("job_id"), F.count_distinct("job_id")).first()
    assert tuple(ids) == (1, 720, 720)


@needs_raw
def test_stream_loads_each_file_once(spark, tmp_path):
    root, mark = str(tmp_path / "star"), str(tmp_path / "mark")
    for _ in range(2):
        run_incremental(spark, RAW, root, mark, DAY, files_per_batch=9)
        assert Star(spark, root).table("job_postings").count() == 360
    log = Star(spark, root).stored("load_log").select("load_id", "first_job_id").orderBy("load_id").collect()
    assert [r.first_job_id for r in log] == [1, 181]


def test_stream_of_small_files(spark, tmp_path):
    """Files that arrive later are loaded by the next run, none twice; both readers give the same star."""
    drops, root, mark = tmp_path / "drops", str(tmp_path / "star"), str(tmp_path / "mark")
    for i in range(3):
        write_records(drops, f"d{i}", {"results": [{"title": f"Dev {i}", "company": "A"}, {"title": "Chef"}]})
    run_incremental(spark, str(drops), root, mark, DAY, files_per_batch=2)
    assert Star(spark, root).table("job_postings").count() == 6
    write_records(drops, "d9", [{"title": "Late"}])
    run_incremental(spark, str(drops), root, mark, DAY)
    run_incremental(spark, str(drops), root, mark, DAY)
    star = Star(spark, root)
    ids = sorted(r.job_id for r in star.table("job_postings").collect())
    assert ids == list(range(1, 8)) and star.table("companies").count() == 2
    with pytest.raises(ValueError):
        run_incremental(spark, str(drops), root, mark, DAY, fmt="csv")


RECORDS = [
    {"Title": "Dev", "company": "HCLTech", "location": "Pune, MH", "salary_min": 1, "salary_max": 2},
    {"title": " ", "company": "X"},
    {"title": "Dev", "company": {"display_name": "hcltech"}, "location": "pune, mh", "description": "Go and SQL"},
    {"title": "Dev", "company": "Hcltéch", "location": "Pune", "country": None},
    {"title": "Dev", "company": "hcltech .", "location": "", "salary": "a, b"},
    {"title": "x" * 256}, {"title": "Big", "salary": "999999999"}, {"title": "Old", "description": "experience 99999999999"},
    {"title": "Dev", "company": "", "country": "UK", "salary": "10"}, {"title": "Dev", "country": 5},
]


def test_quarantine_and_dimensions(spark, tmp_path):
    write_records(tmp_path / "in", "a", RECORDS)
    records = read_lake(spark, str(tmp_path / "in" / "a.json"))
    good, bad, report = transform_records(records)
    assert tuple(report.first()) == (10, 4, 6) and good.count() == 4
    assert {r.ordinal: r.reason for r in bad.collect()} == {
        1: "blank title", 4: "salary is not a number", 5: "text too long", 6: "number out of range",
        7: "number out of range", 9: "country is not text"}
    star = Star(spark, str(tmp_path / "star")).create()
    load_star(check_records(records), star, DAY, "a")
    assert {r.company_name: r.company_id for r in star.table("companies").collect()} == {"HCLTech": 1, "Unknown": 2}
    places = sorted(map(tuple, star.table("locations").collect()))
    assert places == [(1, "Pune", "MH", "India"), (2, "Pune", None, None)]
    postings = {r.job_id: r for r in star.table("job_postings").collect()}
    assert [postings[i].location_id for i in (1, 2, 3, 4)] == [1, 1, 2, None]
    assert postings[4].salary_currency == "GBP" and float(postings[4].salary_mid_usd) == 12.8
    assert postings[1].posted_date == DAY and postings[1].source_url == ""
    assert wide_view(star).count() == 4 and wide_view(star, MODEL_COLUMNS).columns == list(MODEL_COLUMNS)
    assert display_list(wide_view(star, DASHBOARD_COLUMNS)).columns[0] == "Job Title"


def test_repeating_a_load_replaces_it(spark, tmp_path):
    write_records(tmp_path / "in", "a", [{"title": "Dev", "company": "A"}])
    write_records(tmp_path / "in", "b", [{"title": "Dev", "company": "B"}, {"title": "Dev", "company": "a"}])
    star = Star(spark, str(tmp_path / "star"))
    load = lambda name, day: load_star(
        check_records(read_lake(spark, str(tmp_path / "in" / f"{name}.json"))), star, day, name)
    load("a", DAY), load("b", DAY)
    first = sorted((r.job_id, r.company_id, r.posted_date) for r in star.table("job_postings").collect())
    load("b", DAY + dt.timedelta(days=1))
    assert sorted((r.job_id, r.company_id, r.posted_date) for r in star.table("job_postings").collect()) == first
    assert [r.company_id for r in star.table("job_postings").orderBy("job_id").collect()] == [1, 2, 1]


def test_ids_are_dense_and_follow_the_order(spark, tmp_path):
    df = spark.range(0, 5000, 1, 7).select((F.lit(5000) - F.col("id")).alias("x"))
    rows = sequential_ids(df, "n", ["x"], start=10).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(11, 5011)) and [r.x for r in rows] == list(range(1, 5001))
    df.write.parquet(str(tmp_path / "p"))
    numbered = number_rows(spark.read.parquet(str(tmp_path / "p")), "n")
    assert sorted(r.n for r in numbered.collect()) == list(range(1, 5001))


def test_dimension_matches_what_exists(spark):
    dim = spark.createDataFrame([(7, "Acme", None)], "k long, city string, region string")
    rows = spark.createDataFrame([(1, "ACME", None), (2, "acme", "r"), (3, "Ácme", "R"), (4, "b ", None), (5, "b", None)],
                                 "o long, city string, region string")
    added, mapping = resolve_dim(rows, dim, ["city", "region"], "k", "o")
    assert sorted(map(tuple, added.collect())) == [(8, "acme", "r"), (9, "b ", None), (10, "b", None)]
    assert {(r.city, r.region): r.k for r in mapping.collect()} == {
        ("ACME", None): 7, ("acme", "r"): 8, ("Ácme", "R"): 8, ("b ", None): 9, ("b", None): 10}


def test_insert_ignore_and_alignment(spark):
    links = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1)], "job_id long, skill_id long")
    existing = spark.createDataFrame([(1, 2)], "job_id long, skill_id long")
    assert sorted(map(tuple, insert_ignore(links, existing).collect())) == [(1, 1), (2, 1)]
    aligned = align_to_schema(spark.createDataFrame([("c",)], "city string"), SCHEMAS["locations"], {"country": "India"})
    assert tuple(aligned.first()) == (None, "c", None, "India")


def test_training_job(spark, tmp_path):
    from hirelake.plans.jobs import train

    root, path = str(tmp_path / "star"), str(tmp_path / "models")
    assert train(spark, root, path) is None
    kinds = [("Web Developer", "React and CSS", "10000"), ("Data Analyst", "SQL and Excel", "30000")]
    write_records(tmp_path / "in", "a", [
        {"title": kinds[i % 2][0], "description": f"{kinds[i % 2][1]} {i}", "salary": kinds[i % 2][2], "country": "USA"}
        for i in range(40)])
    load_lake(spark, str(tmp_path / "in" / "a.json"), root, DAY)
    out = train(spark, root, path, trees=3, depth=3)
    assert out["accuracy"].first().accuracy == 1.0 and out["regression"].first().mae < 1000
    assert set(out["salary_model"][1]) == {"React", "React.js", "CSS", "SQL", "Excel"}
