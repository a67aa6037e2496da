"""Checked rows → star tables."""

from __future__ import annotations

import copy
import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators.keys import attach_id, number_rows, resolve_spelled, spellings
from hirelake.operators.transform import explode_terms
from hirelake.session import scratch, settle, shared_folder
from hirelake.sources.star import Star, replaced

PLACE = ("city", "region", "country")


def _reserved(star: Star, state: dict, load_id: str, good: int, bad: int, load_date: dt.date) -> dict:
    """The log entry of this load in ``state``, which is changed to hold it.

    A repeated load of as many records finds its own entry and uses the same ids and date. A repeat with other counts
    keeps its date, but gets a new range behind all others, which replaces its entry: ids are never given twice. A
    later load starts behind an earlier one even when that never finished.
    """
    own = state["loads"].get(load_id)
    if own is None:
        logged = star.stored("load_log").filter(F.col("load_id") == load_id).drop("load_id").first()
        own = logged and {**logged.asDict(), "load_date": logged["load_date"].isoformat(), "name": None}
    if own and (own["inserted"], own["skipped"]) == (good, bad):
        return state["loads"].setdefault(load_id, own)
    entry = {"records_read": good + bad, "inserted": good, "skipped": bad, "first_job_id": state["last_job_id"] + 1,
             "load_date": own["load_date"] if own else load_date.isoformat(), "name": own["name"] if own else None}
    state["loads"][load_id], state["last_job_id"] = entry, state["last_job_id"] + good
    return entry


def load_star(checked: DataFrame, star: Star, load_date: dt.date, load_id: str | None = None,
              scraped_at: dt.datetime | None = None) -> DataFrame:
    """Append checked rows (see ``check_records``) to the star; returns the log entry of this load.

    Postings are never deduplicated: loading the same records under a new ``load_id`` doubles them, repeating a
    ``load_id`` replaces that load. Bad rows are kept in the table ``quarantine`` with their file, place, reason and text.

    The rows are parsed once and staged in the shared folder, which is cleared at the end. There are two commits. The
    first adds new dimension members and takes the range of posting ids; it holds for the state that the members were
    looked up in, so if another load committed meanwhile this step (distinct spellings only, not the postings) is done
    again. The second shows the load's postings, links and bad rows all at once. Several loads may run on a star: ids
    are dense and unique, and no reader sees part of a load. Dimension rows are only ever added: a repeat keeps the ids
    that it gave before, because later loads may use them.
    """
    with scratch(star.spark):
        return _load(checked, star.create(), load_date, load_id or uuid.uuid4().hex, scraped_at)


def _load(checked: DataFrame, star: Star, load_date: dt.date, load_id: str, scraped_at: dt.datetime | None) -> DataFrame:
    spark = star.spark
    stage = shared_folder(spark, "stage")
    staged = checked.withColumn("status", F.when(F.col("reason").isNull(), "good").otherwise("bad"))
    staged.sortWithinPartitions("status", "file", "ordinal").write.partitionBy("status").parquet(stage)
    staged = spark.read.schema(staged.schema).parquet(stage)
    good, bad = staged.filter("status = 'good'"), staged.filter("status = 'bad'")
    counts = good.count(), bad.count()
    good = number_rows(good, "_place")
    tags = explode_terms(good, "terms", "_place").withColumnsRenamed({"term": "skill_name", "term_type": "skill_category"})

    members = {  # distinct spellings, with the place where each occurs first
        "companies": (good, ["company_name"], "company_id", ()),
        "locations": (good.filter(F.col("city").isNotNull()), list(PLACE), "location_id", ()),
        "skills": (tags, ["skill_name"], "skill_id", ["skill_category"]),
    }
    spelled = {table: settle(spellings(rows, keys, "_place", keep), "spellings") for table, (rows, keys, _, keep) in members.items()}
    while True:
        number, state = star.current()
        before = star.at(copy.deepcopy(state))
        entry, ids, written = _reserved(before, state, load_id, *counts, load_date), {}, []
        for table, (_, keys, id_col, keep) in members.items():
            added, ids[table] = resolve_spelled(spelled[table], before.table(table), keys, id_col, keep)
            if not added.isEmpty():
                written.append((table, star.put_rows(added, table, load_id)))
                state["live"].setdefault(table, []).append(written[-1][1])
        if star.try_commit(number, state):
            break
        for table, name in written:
            star.drop(table, name)

    # Terms are distinct within a posting and job ids are new, so only spellings that fold together can repeat a pair.
    job_id = (F.col("_place") + (entry["first_job_id"] - 1)).alias("job_id")
    links = attach_id(tags, ids["skills"], ["skill_name"]).select(job_id, "skill_id")
    if ids["skills"].agg((F.count(F.lit(1)) > F.count_distinct("skill_id")).alias("folds")).first()["folds"]:
        links = links.dropDuplicates(["job_id", "skill_id"])
    postings = attach_id(attach_id(good, ids["companies"], ["company_name"]), ids["locations"], PLACE, "left")
    stamp = F.lit(scraped_at) if scraped_at is not None else F.current_timestamp()
    postings = postings.withColumns({
        "job_id": job_id, "posted_date": F.lit(dt.date.fromisoformat(entry["load_date"])), "scraped_at": stamp})
    names = {table: star.put_rows(rows, table, load_id)
             for table, rows in (("quarantine", bad), ("job_skills", links), ("job_postings", postings))}

    def shown(state: dict) -> dict:
        for table, name in names.items():
            state = replaced(state, table, load_id, name)
        state["loads"][load_id] = {**entry, "name": names["job_postings"]}
        return state

    return star.at(star.commit(shown)).stored("load_log").filter(F.col("load_id") == load_id)
