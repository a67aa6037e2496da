"""Name → (Spark callable, SQL or None), and the derived posting table that many queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.sources.lake import record_fields

REGISTRY: dict[str, tuple] = {}


def query(sql: str | None = None):
    def register(function):
        REGISTRY[function.__name__] = (function, sql)
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def spark_sql(spark: SparkSession, sf_dir: str, text: str, dealt: dict[str, str] | None = None) -> DataFrame:
    """Run SQL in which a table is written ``@name``.

    A Parquet file is read in as many tasks as it has row groups, which may be one for millions of narrow rows, and what
    is then done to each row stays in those tasks. Tables in ``dealt`` are dealt to all tasks in the order of the column
    named there; adaptive execution settles the number of parts.
    """
    for name in TABLES:
        rows = f"parquet.`{sf_dir}/{name}.parquet`"
        if name in (dealt or {}):
            rows = f"(SELECT /*+ REPARTITION_BY_RANGE({dealt[name]}) */ * FROM {rows})"
        text = text.replace(f"@{name}", rows)
    return spark.sql(text)


def duck_sql(text: str) -> str:
    return text.replace("@", "")


# One raw posting per order; every part of its text and its keys depends on the row. Valid in both engines.
POSTING_SQL = r"""
SELECT o_orderkey AS id,
  CASE o_orderkey % 19 WHEN 0 THEN 'Senior Data Scientist' WHEN 1 THEN 'Machine Learning Lead'
    WHEN 2 THEN 'DevOps Engineer' WHEN 3 THEN 'Lead Developer' WHEN 4 THEN 'ETL Developer' WHEN 5 THEN 'SRE'
    WHEN 6 THEN 'Head of Data' WHEN 7 THEN 'Chef' WHEN 8 THEN 'Product Analyst' WHEN 9 THEN 'BI Analyst'
    WHEN 10 THEN 'Data Architect' WHEN 11 THEN 'Cloud Engineer' WHEN 12 THEN 'Project Manager'
    WHEN 13 THEN 'Power BI Analytics 5+ yrs' WHEN 14 THEN 'Full Stack Coder (React)' WHEN 15 THEN '   '
    WHEN 16 THEN 'System Administrator' WHEN 17 THEN 'Nurse, 2 to 4 years' ELSE 'Accountant ' || c_mktsegment
  END AS title,
  CASE o_custkey % 7 WHEN 0 THEN lower(c_mktsegment) || ' Ltd' WHEN 1 THEN c_mktsegment || ' Ltd' WHEN 2 THEN ''
    WHEN 3 THEN ' ' || c_mktsegment || ' LTD ' ELSE c_name END AS company,
  CASE o_orderkey % 5 WHEN 0 THEN n_name || ', ' || r_name WHEN 1 THEN n_name WHEN 2 THEN ''
    WHEN 3 THEN n_name || ' ,  ' || r_name || ', Earth' ELSE ', ' || r_name END AS place,
  CASE o_custkey % 9 WHEN 0 THEN 'absent' WHEN 1 THEN 'null' ELSE 'given' END AS country_key,
  CASE o_custkey % 9 WHEN 2 THEN 'United Kingdom' WHEN 3 THEN 'Australia' WHEN 4 THEN 'Ukraine'
    WHEN 5 THEN ' Canada ' WHEN 6 THEN 'France' WHEN 7 THEN 'India' WHEN 8 THEN 'South Africa' END AS country,
  CASE o_orderkey % 8
    WHEN 0 THEN 'Looking for ' || cast(o_custkey % 9 AS string) || ' - ' || cast(o_custkey % 9 + 3 AS string) || ' years. '
    WHEN 1 THEN 'At least ' || cast(o_custkey % 11 AS string) || '+ yrs. '
    WHEN 2 THEN 'Experience: ' || cast(o_custkey % 13 AS string) || ' '
    WHEN 3 THEN cast(o_custkey % 6 AS string) || '.5 to ' || cast(o_custkey % 6 + 4 AS string) || ' Years needed. '
    WHEN 4 THEN 'Exp level - ' || cast(o_custkey % 7 AS string) || '.5 years; '
    WHEN 5 THEN 'No experience needed. ' WHEN 6 THEN 'Experience 2024. ' ELSE '' END
  || CASE o_orderpriority WHEN '1-URGENT' THEN 'Python, SQL and Power BI. Communication matters.'
    WHEN '2-HIGH' THEN 'C# or C++x with ASP.NET, .NET and Scikit-Learn.'
    WHEN '3-MEDIUM' THEN 'React and Node.js on AWS, agile teamwork, problem solving.'
    WHEN '4-NOT SPECIFIED' THEN 'PL/SQL, R&D, go to market, google cloud.' ELSE '' END
  || CASE o_orderstatus WHEN 'F' THEN ' Fully Remote, hybrid possible.' WHEN 'O' THEN ' Flexible work hours.'
    ELSE '' END AS description,
  o_orderkey % 7 AS salary_case,
  cast(o_totalprice AS decimal(12,2)) AS low, cast(o_totalprice AS decimal(12,2)) + 5000 AS high
FROM @orders JOIN @customer ON o_custkey = c_custkey JOIN @nation ON c_nationkey = n_nationkey
  JOIN @region ON n_regionkey = r_regionkey
"""

# The same posting as the JSON text a lake file would hold: odd key spelling, nested company, absent and null keys.
POSTING_JSON_SQL = r"""
SELECT *, '{"Title": "' || title || '", " COMPANY ": '
  || CASE WHEN id % 3 = 0 AND company <> '' THEN '{"display_name": "' || company || '"}' ELSE '"' || company || '"' END
  || ', "location": "' || place || '", "description": "' || description || '"'
  || CASE country_key WHEN 'absent' THEN '' WHEN 'null' THEN ', "country": null'
     ELSE ', "country": "' || country || '"' END
  || CASE salary_case
     WHEN 0 THEN ', "salary_min": ' || cast(low AS string) || ', "Salary_Max": ' || cast(high AS string)
     WHEN 1 THEN ', "salary_min": ' || cast(low AS string)
     WHEN 2 THEN ', "salary_max": "up to ' || cast(high AS string) || ' or ' || cast(low AS string) || '"'
     WHEN 3 THEN ', "salary_min": null, "salary_max": null, "salary": "999"'
     WHEN 4 THEN ', "salary": "$' || cast(low AS string) || ' - $' || cast(high AS string) || '"'
     WHEN 5 THEN ', "salary": "N/A"' ELSE ', "salary": "negotiable, good"' END
  || '}' AS doc
FROM (""" + POSTING_SQL + ") raw"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, POSTING_SQL, {"orders": "o_orderkey"})


def posting_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, POSTING_JSON_SQL, {"orders": "o_orderkey"})


def posting_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, ordinal, fields) as the lake reader gives them."""
    return posting_documents(spark, sf_dir).select(
        F.lit("orders").alias("file"), F.col("id").alias("ordinal"), record_fields("doc").alias("fields")
    )


# ---- the expected result of the transform chain, stated on the parts of the posting ---------------------------------

def years_sql(text: str) -> tuple[str, str]:
    number, unit = r"(\d+(?:\.\d+)?)", "(?:years|yrs|yr|year)"
    ranged = rf"(?i)\b{number}\s*(?:-|to)\s*{number}\s*{unit}\b"
    plus = rf"(?i)\b{number}\s*\+\s*{unit}\b"
    label = rf"(?i)(?:experience|exp)(?:\s*level)?\s*[:-]?\s*{number}\s*{unit}?\b"

    def group(pattern: str, i: int) -> str:
        return f"cast(nullif(regexp_extract({text}, '{pattern}', {i}), '') AS double)"

    low = f"coalesce({group(ranged, 1)}, {group(plus, 1)}, {group(label, 1)})"
    return low, f"coalesce({group(ranged, 2)}, {group(plus, 1)} + 4.0, {group(label, 1)})"


def rule_sql(text: str, rules, default: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), '{word}')" for word in words) + f" THEN '{label}'"
        for label, words in rules
    )
    return f"CASE {cases} ELSE '{default}' END"


def term_sql(text: str, stem: str, ending: str = "") -> str:
    """Whole-word test in RE2 syntax: a neighbour of the other kind, or the edge of the text."""
    def quote(literal: str) -> str:
        return "".join(c if c.isalnum() or c in " _" else f"\\{c}" for c in literal)

    def is_word(char: str) -> bool:
        return char.isalnum() or char == "_"

    before = r"(?:^|[^\p{L}\p{N}_])" if is_word(stem[0]) else r"[\p{L}\p{N}_]"
    def after(char: str) -> str:
        return r"(?:$|[^\p{L}\p{N}_])" if is_word(char) else r"[\p{L}\p{N}_]"
    tail = f"(?:{quote(ending)}{after(ending[-1])}|{after(stem[-1])})" if ending else after(stem[-1])
    return f"regexp_matches({text}, '(?i){before}{quote(stem)}{tail}')"
