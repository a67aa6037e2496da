"""The star schema: table types, additive schema change, and a folder of Parquet tables with committed states."""

from __future__ import annotations

import copy
import datetime as dt
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.sources.manifest import Manifest

MONEY = T.DecimalType(10, 2)
MONEY_USD = T.DecimalType(12, 2)


def _schema(*columns, required=()) -> T.StructType:
    return T.StructType([T.StructField(name, kind, name not in required) for name, kind in columns])


SCHEMAS = {
    "companies": _schema(
        ("company_id", T.LongType()), ("company_name", T.StringType()),
        required=("company_id", "company_name")),
    "locations": _schema(
        ("location_id", T.LongType()), ("city", T.StringType()), ("region", T.StringType()),
        ("country", T.StringType()), required=("location_id", "city")),
    "skills": _schema(
        ("skill_id", T.LongType()), ("skill_name", T.StringType()), ("skill_category", T.StringType()),
        required=("skill_id", "skill_name")),
    "job_postings": _schema(
        ("job_id", T.LongType()), ("company_id", T.LongType()), ("location_id", T.LongType()),
        ("title", T.StringType()), ("description", T.StringType()),
        ("salary_min", MONEY), ("salary_max", MONEY), ("posted_date", T.DateType()),
        ("source_url", T.StringType()), ("scraped_at", T.TimestampType()),
        ("experience_min", T.IntegerType()), ("experience_max", T.IntegerType()),
        ("job_category", T.StringType()), ("is_remote", T.StringType()), ("salary_currency", T.StringType()),
        ("salary_min_usd", MONEY_USD), ("salary_max_usd", MONEY_USD), ("salary_mid_usd", MONEY_USD),
        required=("job_id", "company_id", "title")),
    "job_skills": _schema(
        ("job_id", T.LongType()), ("skill_id", T.LongType()), required=("job_id", "skill_id")),
    "load_log": _schema(
        ("records_read", T.LongType()), ("inserted", T.LongType()), ("skipped", T.LongType()),
        ("first_job_id", T.LongType()), ("load_date", T.DateType())),
    "quarantine": _schema(
        ("file", T.StringType()), ("ordinal", T.LongType()), ("reason", T.StringType()), ("title", T.StringType()),
        ("description", T.StringType()), ("source_url", T.StringType()), ("raw", T.StringType()), required=("reason",)),
}

#: Defaults that an additive schema change gives to rows written before the column existed.
DEFAULTS = {
    "locations": {"country": "India"},
    "skills": {"skill_category": "technical"},
    "job_postings": {"is_remote": "onsite", "salary_currency": "INR"},
}

PARTITIONS = {"job_postings": ("posted_date", "load_id")}

#: Longest text each column of the star takes, in characters (description: bytes).
MAX_LENGTH = {"company_name": 255, "city": 150, "region": 150, "country": 100, "title": 255, "source_url": 500}
MAX_DESCRIPTION_BYTES = 65535


def align_to_schema(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Columns in schema order and type; a missing column is added with its default, or null."""
    defaults = defaults or {}
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
        for f in schema
    ])


#: Tables whose rows a repeated load replaces; dimension rows are only ever added.
REPLACED = ("job_postings", "job_skills", "quarantine")
_EMPTY = {"live": {}, "gone": {}, "dead": [], "loads": {}, "last_job_id": 0}


@dataclass
class Star:
    """A folder with one Parquet table per name in :data:`SCHEMAS`, and the manifest that says what counts.

    Every write makes a partition ``load_id=<load>@<try>`` of its own. A manifest state lists the live partitions; a
    reader sees those of one state, so a load that is running, was cut short or is being repeated shows nothing until
    its commit creates the next state. The file of a state is created exclusively: of two writers one has to look at
    what the other committed and try again. A state has: ``live`` (partitions by table), ``gone`` (loads whose rows in a
    compacted partition were replaced), ``dead`` (partitions to delete), ``loads`` (log entries since the last
    compaction, with the try that counts) and ``last_job_id``.
    """

    spark: SparkSession
    root: str
    pinned: dict | None = None

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def partitions(self, table: str) -> tuple[str, ...]:
        return PARTITIONS.get(table, ("load_id",))

    def _stored_schema(self, table: str) -> T.StructType:
        """Types as read: a column that a file was written without reads as its default, not as null."""
        defaults = DEFAULTS.get(table, {})
        schema = T.StructType([
            T.StructField(f.name, f.dataType, metadata={"EXISTS_DEFAULT": f"'{defaults[f.name]}'"} if f.name in defaults else None)
            for f in SCHEMAS[table]])
        return schema.add("of_load", T.StringType()).add("load_id", T.StringType())

    # ---- states ---------------------------------------------------------------------------------------------------

    @property
    def _manifest(self) -> Manifest:
        return Manifest(self.spark, self.path("_manifest"))

    def current(self) -> tuple[int, dict]:
        """(number, state). Before the first commit everything that lies in the folder counts."""
        found = self._manifest.latest()
        if found is not None:
            return found
        state = copy.deepcopy(_EMPTY)
        for table in SCHEMAS:
            names = {unescape(self.spark, path.rpartition("load_id=")[2]) for path in self._manifest.files.names(self._pattern(table, "*"))}
            if names:
                state["live"][table] = sorted(names)
        if "load_log" in state["live"]:
            last = self.at(state).stored("load_log").agg(F.max(F.col("first_job_id") + F.col("inserted") - 1)).first()[0]
            state["last_job_id"] = last or 0
        return 0, state

    def at(self, state: dict) -> "Star":
        """The star as of one state, whatever is committed meanwhile."""
        return Star(self.spark, self.root, state)

    def snapshot(self) -> "Star":
        return self if self.pinned is not None else self.at(self.current()[1])

    def try_commit(self, number: int, state: dict) -> bool:
        """Make ``state`` the one that follows ``number``; False if another writer has committed since."""
        return self._manifest.put(number + 1, state)

    def commit(self, change) -> dict:
        """Apply ``change`` (state to state) to the latest state, again and again until no other writer was faster."""
        while True:
            number, state = self.current()
            state = change(copy.deepcopy(state))
            if self.try_commit(number, state):
                return state

    def create(self) -> "Star":
        """Create the tables that do not exist yet; existing ones are left as they are."""
        for table in SCHEMAS:
            if not self.exists(table):
                empty = self.spark.createDataFrame([], self._stored_schema(table))
                empty.write.mode("append").partitionBy(*self.partitions(table)).parquet(self.path(table))
        if self._manifest.latest() is None:  # from now on only commits count
            self.try_commit(*self.current())
        return self

    def exists(self, table: str) -> bool:
        return bool(self._manifest.files.names(self.path(table)))

    # ---- reading --------------------------------------------------------------------------------------------------

    def stored(self, table: str) -> DataFrame:
        """The committed rows with the ``load_id`` they came by; empty if nothing was written."""
        state = self.pinned or self.current()[1]
        schema, live = self._stored_schema(table), state["live"].get(table, [])
        if live:
            rows = self.spark.read.schema(schema).parquet(self.path(table)).filter(F.col("load_id").isin(live))
            for name, loads in state["gone"].get(table, {}).items():
                rows = rows.filter((F.col("load_id") != name) | ~F.coalesce(F.col("of_load"), F.lit("")).isin(loads))
        else:
            rows = self.spark.createDataFrame([], schema)
        rows = rows.withColumn("load_id", F.coalesce("of_load", F.regexp_replace("load_id", "@[0-9a-f]{32}$", ""))).select(
            *[name for name in schema.names if name != "of_load"])
        if table != "load_log" or not state["loads"]:
            return rows
        log = [(e["records_read"], e["inserted"], e["skipped"], e["first_job_id"], dt.date.fromisoformat(e["load_date"]), load)
               for load, e in state["loads"].items()]
        return rows.filter(~F.col("load_id").isin(list(state["loads"]))).union(self.spark.createDataFrame(log, rows.schema))

    def table(self, table: str) -> DataFrame:
        return self.stored(table).drop("load_id")

    # ---- writing --------------------------------------------------------------------------------------------------

    def put_rows(self, df: DataFrame, table: str, load_id: str) -> str:
        """Write ``df`` as a partition that nobody sees yet; returns its name for a commit.

        The name is new, so nothing is overwritten: the mode is the one in which every job stages its files in a folder
        of its own, so that writers of one table do not clear each other's.
        """
        name = f"{load_id}@{uuid.uuid4().hex}"
        aligned = align_to_schema(df, SCHEMAS[table], DEFAULTS.get(table))
        if "of_load" in df.columns:
            aligned = align_to_schema(df, T.StructType([*SCHEMAS[table], T.StructField("of_load", T.StringType())]), DEFAULTS.get(table))
        (aligned.withColumn("load_id", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*self.partitions(table)).parquet(self.path(table)))
        return name

    def write(self, df: DataFrame, table: str, load_id: str) -> None:
        """Make ``df`` what ``load_id`` has in ``table``, instead of what an earlier write left there."""
        name = self.put_rows(df, table, load_id)
        self.commit(lambda state: replaced(state, table, load_id, name))

    # ---- upkeep ---------------------------------------------------------------------------------------------------

    def compact(self) -> list[str]:
        """Bring the live partitions of each table into one (of each date, for postings); returns the tables changed.

        The new partition holds the same rows with the load they came by, dealt into files of the advisory size. It
        takes effect by a commit; loads that commit meanwhile stay beside it. If a load that is being brought in is
        replaced meanwhile, that table is left for the next time. The old partitions stay until :meth:`vacuum`.
        """
        number, state = self.current()
        done = []
        for table in SCHEMAS:
            names, gone = state["live"].get(table, []), state["gone"].get(table, {})
            settled = {load: entry for load, entry in state["loads"].items() if entry["name"]} if table == "load_log" else {}
            if len(names) + bool(settled) < 2 and not gone and not settled:
                continue
            rows = self.at(state).stored(table).withColumn("of_load", F.col("load_id"))
            if settled:  # entries of loads that are still running stay in the state
                rows = rows.filter(~F.col("load_id").isin([load for load in state["loads"] if load not in settled]))
            name = self.put_rows(rows.hint("rebalance", *self.partitions(table)[:-1]), table, "compacted")

            def swap(latest: dict, table=table, names=names, gone=gone, name=name, settled=settled) -> dict:
                unchanged = set(names) <= set(latest["live"].get(table, [])) and latest["gone"].get(table, {}) == gone and all(
                    latest["loads"].get(load) == entry for load, entry in settled.items())
                if not unchanged:
                    latest["dead"].append([table, name])
                    return latest
                latest["live"][table] = [name, *(n for n in latest["live"].get(table, []) if n not in names)]
                latest["gone"].pop(table, None)
                latest["dead"] += [[table, n] for n in names]
                latest["loads"] = {load: entry for load, entry in latest["loads"].items() if load not in settled}
                return latest

            if name in self.commit(swap)["live"][table]:
                done.append(table)
        return done

    def vacuum(self, keep: int = 10) -> int:
        """Delete partitions that no state of the last ``keep`` needs any more, and older states; returns how many.

        Readers of an older state lose its files, so run it when reports that began before the last compaction or
        repeated load have ended. Partitions that a running load is writing are never touched.
        """
        dead = self.current()[1]["dead"]
        for table, name in dead:
            self.drop(table, name)
        if dead:
            self.commit(lambda state: {**state, "dead": [d for d in state["dead"] if d not in dead]})
        self._manifest.forget(keep)
        return len(dead)

    def drop(self, table: str, name: str) -> None:
        """Delete the files of a partition."""
        files = self._manifest.files
        for path in files.names(self._pattern(table, escape(self.spark, name))):
            files.delete(path)

    def _pattern(self, table: str, name: str) -> str:
        return "/".join([self.path(table), *["*"] * (len(self.partitions(table)) - 1), f"load_id={name}"])


def replaced(state: dict, table: str, load_id: str, name: str) -> dict:
    """The state in which ``name`` is all that ``load_id`` has in ``table``."""
    live = state["live"].setdefault(table, [])
    old = [n for n in live if n == load_id or re.fullmatch(re.escape(load_id) + "@[0-9a-f]{32}", n)]
    state["live"][table] = [n for n in live if n not in old] + [name]
    state["dead"] += [[table, n] for n in old]
    for compacted in (n for n in live if re.fullmatch("compacted@[0-9a-f]{32}", n)):
        loads = state["gone"].setdefault(table, {}).setdefault(compacted, [])
        if load_id not in loads:
            loads.append(load_id)
    return state


def escape(spark: SparkSession, name: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)


def unescape(spark: SparkSession, name: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)
