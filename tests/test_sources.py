"""Files in, files out."""

import datetime as dt
import json

from pyspark.sql import functions as F

from hirelake.functions.text import text_of
from hirelake.operators.transform import check_records
from hirelake.sources.lake import explode_documents, field, field_sql, format_of, has_field, read_lake
from hirelake.sources.payload import flatten_payload
from hirelake.sources.sinks import append_raw_lake, export_csv, union_batches


def titles(records):
    return sorted(r["t"] for r in records.select(text_of(field_sql("title")).alias("t")).collect())


def test_document_shapes(spark, tmp_path):
    shapes = {
        "a": [{"title": "1"}, {"title": "2"}], "b": {"results": [{"title": "3"}]},
        "c": {"results": {"x": 1}, "jobs": [{"title": "4"}]}, "d": {"data": [{"title": "5"}]},
        "e": {"jobs": "[1]", "postings": [{"title": "6"}]}, "f": {"title": "7"}, "g": [], "h": {"results": []},
    }
    for name, shape in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(shape))
    (tmp_path / "z.json").write_text("no json")
    records = read_lake(spark, f"{tmp_path}/*.json")
    good = records.filter("fields is not null")
    assert titles(good) == ["1", "2", "3", "4", "5", "6", "7"]
    assert records.filter("fields is null").count() == 1
    ordinals = good.filter(F.col("file").endswith("a.json")).select("ordinal").orderBy("ordinal").collect()
    assert [r.ordinal for r in ordinals] == [0, 1]


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "x.CSV").write_text(' Title ,COMPANY\n"a ""b""\nc",Acme\n,Empty\n', encoding="utf-8")
    records = read_lake(spark, str(tmp_path / "x.CSV"))
    got = records.select(text_of(field_sql("title")).alias("t"), text_of(field_sql("company")).alias("c"),
                         has_field("country").alias("h")).collect()
    assert sorted(map(tuple, got)) == [("", "Empty", False), ('a "b"\nc', "Acme", False)]


def test_format_follows_the_suffix():
    assert [format_of(p) for p in ("a.json", "a.JSON", "a.csv", "a.txt", "json")] == ["json", "json", "csv", "csv", "csv"]


def test_lake_sink_appends_and_skips_empty_batches(spark, tmp_path):
    lake = str(tmp_path / "lake")
    batch = spark.createDataFrame([("t", None)], "title string, salary_min double")
    assert append_raw_lake(batch.limit(0), lake, "2026-01-01") is None
    append_raw_lake(batch, lake, "2026-01-01")
    append_raw_lake(batch, lake, "2026-01-01")
    records = read_lake(spark, lake, "lines")
    rows = records.select(has_field("salary_min").alias("h"), field("salary_min").cast("double").alias("v")).collect()
    assert [tuple(r) for r in rows] == [(True, None), (True, None)]


def test_csv_export_has_a_header(spark, tmp_path):
    path = export_csv(spark.createDataFrame([(1, 'a "q", b')], "x int, y string"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.csv(path, header=True, escape='"').collect()] == [("1", 'a "q", b')]


def test_payload_flattening(spark):
    jobs = [
        {"title": " Dev ", "company": {"display_name": "Acme "}, "location": {"area": ["UK", "London "]},
         "description": " d ", "salary_min": 10, "salary_max": 20.5, "redirect_url": "u"},
        {"title": "No members"},
        {"title": "Zero", "location": {"area": []}, "salary_min": 0, "salary_max": 9},
        {"title": "Low", "location": {"area": None}, "salary_min": 7, "company": {}},
        {"title": None}, {"title": "x", "company": None}, {"title": "x", "location": None},
        {"title": "x", "description": None}, {"title": "x", "company": {"display_name": None}}, 5,
    ]
    df = spark.createDataFrame([(json.dumps({"results": jobs}), "in"), ("{}", "in"), (None, "gb"), ("bad", "gb"),
                                (json.dumps({"results": [{"title": "GB"}]}), "gb")], "p string, m string")
    good, broken = flatten_payload(df, "p", "m", F.lit(dt.datetime(2026, 1, 2, 3, 4, 5)))
    rows = {r["title"]: r.asDict() for r in good.collect()}
    assert set(rows) == {"Dev", "No members", "Zero", "Low", "GB"} and broken.count() == 6
    dev, bare = rows["Dev"], rows["No members"]
    assert (dev["company"], dev["location"], dev["description"], dev["salary"]) == ("Acme", "London ", "d", "10 - 20.5")
    assert (dev["country"], dev["scraped_at"], dev["source_url"]) == ("India", "2026-01-02 03:04:05", "u")
    assert (bare["company"], bare["location"], bare["salary"], bare["source_url"]) == ("N/A", "N/A", "N/A", "")
    assert bare["description"] == "No description provided." and rows["GB"]["country"] == "United Kingdom"
    assert rows["Zero"]["salary"] == "N/A" and rows["Low"]["salary"] == "7" and rows["Low"]["location"] == "N/A"


def test_union_is_by_name_and_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("x", 1), ("y", 2)], "s string, i int")
    assert sorted(map(tuple, union_batches(a, b).collect())) == [(1, "x"), (1, "x"), (2, "y")]


def records_of(spark, *documents):
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(documents)], "file string, value string")
    rows = explode_documents(df).select("file", "ordinal", text_of(field_sql("a")).alias("a"), F.col("fields").isNull().alias("bad"), "raw")
    return [tuple(r)[1:] for r in rows.orderBy("file", "ordinal").collect()]


def test_a_broken_line_takes_no_other_line_with_it(spark):
    lines = [f'{{"a": {i}}}' for i in range(10)]
    for place in (0, 4, 9):
        broken = [*lines]
        broken[place] = '{"a": '
        got = records_of(spark, "\r\n".join(broken) + "\n\n")
        assert [g[3] for g in got] == broken and [g[2] for g in got] == [i == place for i in range(10)]
        assert [g[1] for g in got if not g[2]] == [str(i) for i in range(10) if i != place]


def test_text_behind_a_value_is_not_lost_in_silence(spark):
    for text in ('{"a": 1} x', '{"a": 1} {"a": 2}', '{"a": 1}, {"a": 2}', '{"a": 1}]', '{"a": 1}}', '[{"a": 1}', '[{"a": 1}\n{"a": 2}\n', "x", "5", "null"):
        assert records_of(spark, text) == [(0, "", True, text)], text
    assert records_of(spark, '{"a": 1}\nx\n5\n{"a": 2} {"a": 3}') == [
        (0, "1", False, '{"a": 1}'), (1, "", True, "x"), (2, "", True, "5"), (3, "", True, '{"a": 2} {"a": 3}')]


def test_documents_over_several_lines_stay_whole(spark):
    assert [r[:3] for r in records_of(spark, '{\n "a": [\n  {"b": 1}\n ]\n}')] == [(0, '[{"b":1}]', False)]
    assert [r[1] for r in records_of(spark, '\n[\n{"a": 1},\n{"a": 2}\n]\n')] == ["1", "2"]
    assert [r[1] for r in records_of(spark, '{"results":\n[{"a": 1},\n{"a": 2}\n]}')] == ["1", "2"]
    assert records_of(spark, "[]") == [] and records_of(spark, "") == [(0, "", True, "")]


def test_the_last_of_equal_keys_counts(spark):
    got = records_of(spark, '[{"a": 1, " A ": 2}, {"A": 1, "a": null}, {"a": 1, "b": 5, "a\\u00a0": "x", "B": 6}]')
    assert [g[1] for g in got] == ["2", "", "x"]


def test_broken_records_keep_their_text(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"title": "t"}\n{"title": \n{"title": " ", "company": "c"}\n')
    (tmp_path / "y.csv").write_text('Title,Company\n" ","a, ""b"""\n')
    rows = check_records(read_lake(spark, str(tmp_path))).select("reason", "raw").collect()
    assert {tuple(r) for r in rows} == {
        (None, None), ("unreadable record", '{"title": '), ("blank title", '{"title": " ", "company": "c"}'),
        ("blank title", '{"Title":" ","Company":"a, \\"b\\""}')}
