"""Loads that repeat, overlap and stream; lakes of several formats."""

import datetime as dt
import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from hirelake.operators.integrity import integrity_report
from hirelake.operators.load import load_star
from hirelake.operators.transform import check_records
from hirelake.sources.lake import field, read_lake
from hirelake.sources.manifest import Files, Manifest
from hirelake.sources.sinks import append_raw_lake
from hirelake.sources.star import Star
from hirelake.streaming.incremental import run_incremental

DAY = dt.date(2026, 1, 2)


def checked(spark, folder, records):
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(records))
    return check_records(read_lake(spark, str(folder / "a.json")))


def posting(i, text="Python"):
    return {"title": f"t{i}", "company": f"c{i}", "location": f"l{i}", "description": text, "source_url": f"u{i}"}


def faults(star):
    return {r[0]: r[1] for r in integrity_report(star).collect() if r[1]}


def test_repeated_loads_keep_ids(spark, tmp_path):
    star = Star(spark, str(tmp_path / "star")).create()
    one = checked(spark, tmp_path / "one", [posting(i) for i in range(4)])
    load_star(one, star, DAY, "one")
    before = sorted(map(tuple, star.table("companies").collect()))
    load_star(checked(spark, tmp_path / "two", [posting(i) for i in range(6)]), star, DAY, "two")
    load_star(one, star, DAY, "one")
    assert star.table("job_postings").count() == 10
    assert not faults(star)
    companies = sorted(map(tuple, star.table("companies").collect()))
    assert companies[:4] == before and len(companies) == 6
    load_star(checked(spark, tmp_path / "more", [posting(i) for i in range(8)]), star, DAY, "one")
    ids = [r[0] for r in star.table("job_postings").select("job_id").collect()]
    assert len(ids) == len(set(ids)) == 14 and not faults(star)
    load_star(checked(spark, tmp_path / "none", [posting(i, "nothing") for i in range(8)]), star, DAY, "one")
    assert star.stored("job_skills").filter("load_id = 'one'").count() == 0
    assert star.table("job_postings").count() == 14


def test_two_streams_and_own_sink(spark, tmp_path):
    root = str(tmp_path / "star")
    for name, n in (("x", 4), ("y", 3)):
        rows = spark.createDataFrame([tuple(posting(i).values()) for i in range(n)], list(posting(0)))
        append_raw_lake(rows.coalesce(1), str(tmp_path / name), "2026-01-02")
        run_incremental(spark, str(tmp_path / name), root, str(tmp_path / f"mark-{name}"), DAY)
    assert Star(spark, root).table("job_postings").count() == 7


def test_lake_formats(spark, tmp_path):
    lake = tmp_path / "lake"
    append_raw_lake(spark.createDataFrame([tuple(posting(i).values()) for i in range(10)], list(posting(0))).coalesce(2), str(lake), "2026-01-02")
    (lake / "array.json").write_text(json.dumps([posting(20), posting(21)], indent=1))
    (lake / "a.csv").write_text("title,company\nta,ca\n")
    (lake / "b.csv").write_text("company,title\ncb,tb\n")
    rows = read_lake(spark, str(lake)).select(field("title").cast("string").alias("t"), field("company").cast("string").alias("c")).collect()
    assert len(rows) == 14
    assert {("ta", "ca"), ("tb", "cb"), ("t20", "c20"), ("t9", "c9")} <= {(r.t.strip('"'), r.c.strip('"')) for r in rows}
    assert read_lake(spark, [str(lake / "a.csv"), str(lake / "array.json")]).count() == 3


def test_quarantine_is_kept_and_cleared(spark, tmp_path):
    star = Star(spark, str(tmp_path / "star")).create()
    bad = {**posting(1), "title": " "}
    load_star(checked(spark, tmp_path / "one", [posting(0), bad, posting(2)]), star, DAY, "one")
    row, = star.table("quarantine").collect()
    assert row["reason"] == "blank title" and row["source_url"] == "u1" and row["file"].endswith("a.json")
    load_star(checked(spark, tmp_path / "two", [posting(0)]), star, DAY, "one")
    assert star.table("quarantine").count() == 0


def test_rows_of_before_a_column_read_its_default(spark, tmp_path):
    star = Star(spark, str(tmp_path / "star"))
    old = spark.createDataFrame([(1, "a", "old")], "location_id long, city string, load_id string")
    old.write.partitionBy("load_id").parquet(star.path("locations"))
    star.write(spark.createDataFrame([(2, "b", None)], "location_id long, city string, country string"), "locations", "new")
    rows = {r["city"]: (r["region"], r["country"]) for r in star.table("locations").collect()}
    assert rows == {"a": (None, "India"), "b": (None, None)}


def test_a_load_that_stops_shows_nothing(spark, tmp_path, monkeypatch):
    star = Star(spark, str(tmp_path / "star")).create()
    load_star(checked(spark, tmp_path / "one", [posting(i) for i in range(3)]), star, DAY, "one")
    seen = [tuple(sorted(map(tuple, star.table(t).collect()))) for t in ("job_postings", "job_skills", "quarantine")]
    two = checked(spark, tmp_path / "two", [posting(i, "Java") for i in range(5)] + [{"title": ""}])
    commit = Star.commit

    def stop(self, change):
        raise KeyboardInterrupt

    monkeypatch.setattr(Star, "commit", stop)  # all files of the load are written, its last commit is not
    for load in ("two", "one"):
        with pytest.raises(KeyboardInterrupt):
            load_star(two, star, DAY, load)
        assert [tuple(sorted(map(tuple, star.table(t).collect()))) for t in ("job_postings", "job_skills", "quarantine")] == seen
    monkeypatch.setattr(Star, "commit", commit)
    load_star(two, star, DAY, "two")
    assert star.table("job_postings").count() == 8 and star.table("quarantine").count() == 1 and not faults(star)
    assert sorted(r[0] for r in star.stored("job_postings").filter("load_id = 'two'").select("job_id").collect()) == list(range(4, 9))


def test_two_loads_at_once(spark, tmp_path):
    """Members that both bring are made once, ids are dense and unique, whichever load commits first."""
    star = Star(spark, str(tmp_path / "star")).create()
    inputs = [checked(spark, tmp_path / name, [{**posting(i), "company": c, "location": p} for i, (c, p) in enumerate(rows)]) for name, rows in (
        ("a", [("Acme", "X"), ("Beta", "Y"), ("acmé", "X")]), ("b", [("ACME", "x"), ("Gamma", "Y"), ("beta", "Z")]), ("c", [("Gamma", "Q")] * 4))]
    with ThreadPoolExecutor(3) as pool:
        for done in [pool.submit(load_star, rows, star, DAY, f"load{i}") for i, rows in enumerate(inputs)]:
            done.result()
    assert sorted(r[0] for r in star.table("job_postings").select("job_id").collect()) == list(range(1, 11))
    assert sorted(r.company_id for r in star.table("companies").collect()) == [1, 2, 3]
    assert sorted(r.location_id for r in star.table("locations").collect()) == [1, 2, 3, 4]
    assert not faults(star)


def test_compaction_keeps_reports_and_leaves_one_partition(spark, tmp_path):
    star = Star(spark, str(tmp_path / "star")).create()
    work = tmp_path / "work"
    for i in range(6):
        rows = checked(spark, tmp_path / f"f{i}", [posting(i), posting(i + 1, "Java, Go"), {"title": " "}])
        load_star(rows, star, DAY + dt.timedelta(days=i % 2), f"load{i}")
    tables = ("companies", "locations", "skills", "job_postings", "job_skills", "quarantine", "load_log")
    contents = lambda: [sorted(map(repr, star.stored(t).collect())) for t in tables]
    before, held = contents(), star.snapshot()
    assert set(star.compact()) == set(tables) - {"skills"}  # all skills came with the first load
    assert contents() == before and star.compact() == []
    assert held.table("job_postings").count() == 12  # a reader of the state before still finds its files
    assert star.vacuum() > 0 and contents() == before
    names = {p.name for p in (tmp_path / "star" / "companies").iterdir() if p.name.startswith("load_id=")}
    assert len(names) == 1 and len(list((tmp_path / "star" / "job_postings").glob("posted_date=*/load_id=*"))) == 2
    load_star(checked(spark, tmp_path / "again", [posting(0), posting(9), {"title": ""}]), star, DAY, "load0")  # of a compacted load
    assert star.table("job_postings").count() == 12 and star.table("quarantine").count() == 6 and not faults(star)
    assert sorted(r[0] for r in star.stored("job_postings").filter("load_id = 'load0'").select("job_id").collect()) == [1, 2]
    after = contents()
    star.compact()
    assert contents() == after and star.current()[1]["gone"] == {} and not work.exists()


def test_scratch_is_cleared(spark, tmp_path):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    folder = os.path.join(base.removeprefix("file:"), "hirelake")
    star = Star(spark, str(tmp_path / "star")).create()
    rows = checked(spark, tmp_path / "one", [posting(i) for i in range(3)])
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    log = load_star(rows, star, DAY, "one")
    append_raw_lake(spark.createDataFrame([tuple(posting(5).values())], list(posting(0))), str(tmp_path / "lake"), "2026-01-02")
    run_incremental(spark, str(tmp_path / "lake"), star.root, str(tmp_path / "mark"), DAY)
    assert set(os.listdir(folder) if os.path.isdir(folder) else ()) == before
    assert log.first()["inserted"] == 3 and star.table("job_postings").count() == 4


def test_manifest_states_are_created_once(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "m"))
    assert manifest.latest() is None
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: manifest.put(1, {"by": i}), range(8)))
    assert sum(won) == 1 and manifest.latest() == (1, {"by": won.index(True)})
    for number in range(2, 15):
        assert manifest.put(number, {"n": number})
    manifest.forget(3)
    assert manifest.latest() == (14, {"n": 14}) and len(list((tmp_path / "m").iterdir())) == 3


def test_stream_of_mixed_files(spark, tmp_path):
    lake, root, mark = tmp_path / "lake.v1" / "2026.01", str(tmp_path / "star"), str(tmp_path / "mark")
    lake.mkdir(parents=True)
    (lake / "a.json").write_text(json.dumps({"results": [posting(0), posting(1)]}, indent=1))
    (lake / "b.JSON").write_text("\n".join([json.dumps(posting(2)), "{", json.dumps(posting(3))]))
    (lake / "c.csv").write_text('company,title\nc4,"t4, ""x"""\n')
    (lake / "d.CSV").write_text('Title,Company,Location\nt5,c5,"l5\n, r"\n')
    (lake / "e.txt").write_text("title\nno posting\n")
    (lake / "f.json.tmp").write_text(json.dumps(posting(99)))
    run_incremental(spark, str(tmp_path / "lake.v1"), root, mark, DAY)
    star = Star(spark, root)
    assert sorted(r.title for r in star.table("job_postings").collect()) == ["t0", "t1", "t2", "t3", 't4, "x"', "t5"]
    assert [r.raw for r in star.table("quarantine").collect()] == ["{"]
    (lake / "g.csv").write_text("title\nt6\nt7\n")
    for _ in range(2):
        run_incremental(spark, str(tmp_path / "lake.v1"), root, mark, DAY, files_per_batch=1)
    assert star.table("job_postings").count() == 8 and star.stored("load_log").count() == 2 and not faults(star)
    assert read_lake(spark, str(tmp_path / "lake.v1")).count() == 9


def test_files_through_the_file_system_interface(spark, tmp_path, monkeypatch):
    """The way that folders outside local disks go."""
    monkeypatch.setattr(Files, "_local", lambda self, path: None)
    files = Files(spark, str(tmp_path))
    (tmp_path / "m").mkdir()
    assert files.create(f"{tmp_path}/m/1.json", "é") and not files.create(f"{tmp_path}/m/1.json", "other")
    assert files.read(f"{tmp_path}/m/1.json") == "é"
    assert [n.rpartition("/")[2] for n in files.names(f"{tmp_path}/m/[0-9]*.json")] == ["1.json"]
    assert files.is_folder(f"{tmp_path}/m") and not files.is_folder(f"{tmp_path}/m/1.json") and not files.is_folder(f"{tmp_path}/*")
    files.delete(f"{tmp_path}/m")
    assert files.names(f"{tmp_path}/m") == []
