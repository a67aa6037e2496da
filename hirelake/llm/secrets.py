"""Secret scans by an incremental ledger of content-addressed blobs. Built-in functions only."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import new_names, shared_folder
from hirelake.llm.spans import found


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``part`` has ``least`` characters. A changed rule needs a new version."""

    kind: str
    version: int
    pattern: str
    least: int = 1
    part: int = 0
    #: SQL that is true for every text with a match.
    needs: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which kinds are listed. A hex run of under 32 characters cannot match.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", 8, 1, "text RLIKE '[:=]'"),
    Rule("access", 1, r"AKIA[A-Z0-9]++", 16, 0, "instr(text, 'AKIA') > 0"),
    Rule("hex", 1, r"[0-9a-f]{32,}+", 32, 0, None),
)
#: What the scan adds to them.
MORE_RULES = (
    Rule("key_block", 1, r"-----BEGIN\x20[A-Z\x20]{0,40}PRIVATE\x20KEY-----", 1, 0, "instr(text, '-----BEGIN ') > 0"),
    Rule("signed_token", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 1, 0, "instr(text, 'eyJ') > 0"),
)
RULES = BASE_RULES + MORE_RULES
_FINDINGS = "array<struct<rule:string,start:int,stop:int>>"


class BlobLedger:
    """What has been scanned: a Parquet folder of (blob, rules, findings), one row per blob and scan.

    A blob is named by the SHA-256 of its text. Each scan appends a folder of its own, so a repeated or failed one
    spoils nothing; a blob that two scans have both read is read back once. One scan at a time should run on a ledger.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"blob binary, rules array<string>, findings {_FINDINGS}").parquet(f"{self.path}/scan=*")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], f"blob binary, rules array<string>, findings {_FINDINGS}")

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
        """Scan the texts that the ledger does not know under one of ``rules``, each once, however many rows have them.

        Copies are combined before the shuffle, so a text that makes up a third of all rows is moved once per task.
        """
        blobs = (versions.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
                 .groupBy("blob").agg(F.first("text").alias("text")))
        known = self.rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        wanted = F.array(*(F.lit(r.key) for r in rules))
        unseen = (blobs.join(known, "blob", "left")
                  .select("blob", "text", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules"))
                  .filter(F.size("rules") > 0))
        findings = F.concat(*(self._findings(rule) for rule in rules))
        unseen.select("blob", "rules", findings.cast(_FINDINGS).alias("findings")).write.mode("append").parquet(f"{self.path}/scan={uuid.uuid4().hex}")

    @staticmethod
    def _findings(rule: Rule) -> Column:
        matches = found("text", rule.pattern, f"array_contains(rules, '{rule.key}')" + (f" AND {rule.needs}" if rule.needs else ""))
        long_enough = F.filter(matches, lambda m: F.char_length(F.regexp_extract(m["found"], rule.pattern, rule.part) if rule.part else m["found"]) >= rule.least)
        return F.transform(long_enough, lambda m: F.struct(F.lit(rule.key).alias("rule"), m["start"].alias("start"), m["stop"].alias("stop")))

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, findings) of the blobs in which one of ``rules`` has found something, sorted by start, then rule."""
        order = F.array(*(F.lit(r.key) for r in rules))
        own = F.filter("findings", lambda f: F.array_contains(order, f["rule"]))
        with_any = self.rows().select("blob", own.alias("findings")).filter(F.size("findings") > 0)
        every = with_any.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))
        return every.select("blob", F.sort_array(F.transform("findings", lambda f: F.struct(
            f["start"].alias("start"), (F.array_position(order, f["rule"]) - 1).alias("rule"), f["stop"].alias("stop")))).alias("findings"))

    def joined(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
        """``versions`` (every path and version of it) with a column findings: array of (start, rule, stop), where rule
        is the place in ``rules``; empty if there is none. Only blobs with findings take part in the join."""
        name, = new_names(versions, "findings")
        blob, found_blob, found_here = new_names(versions, "_blob", "_found_blob", "_found")
        found_in = self.findings(rules).withColumnsRenamed({"blob": found_blob, "findings": found_here})
        named = versions.withColumn(blob, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))
        return named.join(found_in, F.col(blob) == F.col(found_blob), "left").select(
            *(F.col(f"`{c}`") for c in versions.columns),
            F.coalesce(found_here, F.array().cast("array<struct<start:int,rule:bigint,stop:int>>")).alias(name))


def scanned(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[BlobLedger, DataFrame]:
    """Scan ``docs`` into the ledger at ``ledger_path`` (a new one in the shared folder if none is named)."""
    ledger = BlobLedger(docs.sparkSession, ledger_path or shared_folder(docs.sparkSession, "blob-ledger"))
    ledger.scan(docs, rules)
    return ledger, ledger.joined(docs, rules)


def secret_documents(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``.

    A null text is the empty text. Repeated rows each get a row, a null doc_id stays null, other columns are left out,
    and an empty table gives no rows.
    """
    ledger = scanned(docs.select("doc_id", "text"), ledger_path)[0]
    marked = docs.select("doc_id", F.col("text"))
    rows = ledger.joined(marked, RULES).drop("text")
    kinds = F.array(*(F.lit(r.kind) for r in RULES))
    base = F.filter("findings", lambda f: f["rule"] < len(BASE_RULES))

    def written(spans) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"].cast("int")), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(i: int) -> Column:
        return F.size(F.filter("findings", lambda f: f["rule"] == i)).cast("long")

    return rows.select(
        "doc_id", *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("findings")).alias("spans"))


def redacted(docs: DataFrame, ledger_path: str | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each found span of the text replaced by ``mark`` (overlapping spans by one); other columns stay,
    and a text without findings, a null one too, stays as it was. Repeated rows and null ids are treated like others, an
    empty table gives no rows, and extra columns may have any names."""
    found_in = scanned(docs, ledger_path)[1]
    name = found_in.columns[-1]
    clean = F.expr(f"""aggregate(`{name}`, named_struct('at', 0, 'out', ''), (a, f) ->
        CASE WHEN f.start >= a.at THEN named_struct('at', f.stop, 'out', concat(a.out, substring(text, a.at + 1, f.start - a.at), '{mark}'))
             ELSE named_struct('at', greatest(a.at, f.stop), 'out', a.out) END, a -> concat(a.out, substring(text, a.at + 1)))""")
    return found_in.select(*(F.when(F.size(name) > 0, clean).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
