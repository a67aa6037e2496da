"""Row transforms over the derived postings, documents, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import (
    POSTING_SQL, duck_sql, posting_records, postings, query, rule_sql, table, term_sql, years_sql,
)
from hirelake import rules
from hirelake.functions import enrich
from hirelake.functions.text import amounts_in_text, split_place, text_of, title_plus_description
from hirelake.operators.transform import (
    check_records, country_of, load_report, resolve_salary, tag_terms, whole_years,
)
from hirelake.rules import Term
from hirelake.sources.lake import field_sql, has_field, record_fields
from hirelake.sources.sinks import quarantine_counts

RAW = "WITH raw AS (" + duck_sql(POSTING_SQL) + ")\n"
LOW, HIGH = years_sql("description")
TITLE_LOW, TITLE_HIGH = years_sql("title")
YEARS_MIN = f"coalesce({LOW}, {TITLE_LOW})"
YEARS_MAX = f"CASE WHEN {LOW} IS NULL THEN {TITLE_HIGH} ELSE {HIGH} END"
SALARY_MIN = "CASE WHEN salary_case IN (0, 1, 2, 4) THEN cast(low AS double) END"
SALARY_MAX = "CASE WHEN salary_case IN (0, 4) THEN cast(high AS double) WHEN salary_case IN (1, 2) THEN cast(low AS double) END"
CURRENCY = rule_sql("country", rules.CURRENCY_RULES, rules.CURRENCY_DEFAULT)
RATE = "CASE currency " + " ".join(f"WHEN '{c}' THEN {r}::double" for c, r in rules.USD_RATES.items()) + " END"
ROLE = rule_sql("title", rules.ROLE_RULES, rules.ROLE_DEFAULT)
MODE = rule_sql("description", rules.MODE_RULES, rules.MODE_DEFAULT)


@query(RAW + f"SELECT id, {YEARS_MIN} AS years_min, {YEARS_MAX} AS years_max FROM raw")
def experience_years(spark, sf_dir):
    years = enrich.years_range("description", "title")
    return postings(spark, sf_dir).select("id", years.alias("y")).select(
        "id", F.col("y.min").alias("years_min"), F.col("y.max").alias("years_max"))


SALARY_TEXT = """CASE o_orderstatus WHEN 'F' THEN '$' || cast(cast(o_totalprice AS decimal(12,2)) AS string) || ' - $1,250,000.75'
  WHEN 'O' THEN 'pays ' || cast(o_custkey AS string) || ',000 or 250 or 3,000.25' WHEN 'P' THEN
  CASE o_orderpriority WHEN '1-URGENT' THEN 'N/A' WHEN '2-HIGH' THEN 'good, fair' WHEN '3-MEDIUM' THEN NULL
  ELSE cast(o_custkey AS string) || ' a year' END END"""


@query(f"""
WITH t AS (SELECT o_orderkey, regexp_extract_all(coalesce({SALARY_TEXT}, ''), '[\\d,]+(?:\\.\\d+)?') AS hits FROM orders),
n AS (SELECT o_orderkey, list_transform(hits, lambda h: try_cast(replace(h, ',', '') AS double)) AS v FROM t)
SELECT o_orderkey, list_min(v) AS amount_min, list_max(v) AS amount_max,
  len(list_filter(v, lambda x: x IS NULL)) > 0 AS broken FROM n""")
def salary_parse(spark, sf_dir):
    parsed = amounts_in_text(SALARY_TEXT).alias("a")
    return table(spark, sf_dir, "orders").select("o_orderkey", parsed).select(
        "o_orderkey", F.col("a.min").alias("amount_min"), F.col("a.max").alias("amount_max"),
        F.col("a.bad").alias("broken"))


@query(RAW + f"""SELECT id, {SALARY_MIN} AS salary_min, {SALARY_MAX} AS salary_max, salary_case = 6 AS broken FROM raw""")
def salary_resolve(spark, sf_dir):
    return posting_records(spark, sf_dir).select(F.col("ordinal").alias("id"), resolve_salary().alias("s")).select(
        "id", F.col("s.min").alias("salary_min"), F.col("s.max").alias("salary_max"), F.col("s.bad").alias("broken"))


@query(RAW + """SELECT id, CASE WHEN place <> '' THEN trim(string_split(place, ',')[1]) END AS city,
  CASE WHEN place <> '' THEN trim(string_split(place, ',')[2]) END AS region FROM raw""")
def location_split(spark, sf_dir):
    return postings(spark, sf_dir).select("id", split_place("place").alias("p")).select("id", "p.city", "p.region")


@query(RAW + f"SELECT id, {ROLE} AS job_category FROM raw")
def role_category(spark, sf_dir):
    return postings(spark, sf_dir).select("id", enrich.role_category("title").alias("job_category"))


@query(RAW + f"SELECT id, {MODE} AS is_remote FROM raw")
def work_mode(spark, sf_dir):
    return postings(spark, sf_dir).select("id", enrich.work_mode("description").alias("is_remote"))


@query(RAW + f""", c AS (SELECT id, cast(low AS double) AS lo, CASE WHEN salary_case > 0 THEN cast(high AS double) END AS hi,
  {CURRENCY} AS currency FROM raw),
r AS (SELECT *, {RATE} AS rate FROM c)
SELECT id, currency, lo * rate AS min_usd, coalesce(hi, lo) * rate AS max_usd,
  (lo * rate + coalesce(hi, lo) * rate) / 2.0 AS mid_usd FROM r""")
def currency_usd(spark, sf_dir):
    high = "CASE WHEN salary_case > 0 THEN cast(high AS double) END"
    usd = enrich.to_usd("cast(low AS double)", high, "country")
    return postings(spark, sf_dir).select("id", usd.alias("u")).select(
        "id", "u.currency", "u.min_usd", "u.max_usd", "u.mid_usd")


@query(RAW + """SELECT id, CASE country_key WHEN 'absent' THEN 'India' ELSE country END AS country FROM raw""")
def country_default(spark, sf_dir):
    return posting_records(spark, sf_dir).select(F.col("ordinal").alias("id"), country_of().alias("country"))


def _tag_sql(source: str, id_col: str, text: str, terms) -> str:
    cases = ", ".join(
        f"CASE WHEN {term_sql(text, t.stem, t.ending)} THEN '{t.kind}|{t.name}' END" for t in terms)
    return (f"SELECT {id_col}, split_part(h, '|', 2) AS term, split_part(h, '|', 1) AS term_type FROM "
            f"(SELECT {id_col}, unnest([{cases}]) AS h FROM {source}) x WHERE h IS NOT NULL")


@query(RAW + _tag_sql("(SELECT id, title || ' ' || description AS t FROM raw)", "id", "t", rules.default_terms()))
def skill_tags(spark, sf_dir):
    text = title_plus_description("title", "description")
    return tag_terms(postings(spark, sf_dir).select("id", text.alias("t")), "t", "id")


WORDS = [Term("the", "en", "the"), Term("and", "en", "and"), Term("le", "fr", "le"), Term("que", "fr", "que"),
         Term("der", "de", "der"), Term("für", "de", "für"), Term("là", "es", "là"), Term("et en", "fr", "et en"),
         Term("e-mail", "any", "e-mail"), Term("(c)", "any", "(c)"), Term("the.", "en", "the", "."), Term("http:", "any", "http:")]


@query(_tag_sql("documents", "doc_id", "text", WORDS))
def document_terms(spark, sf_dir):
    """Whole texts in four languages against a parameter dictionary with accents, a phrase and punctuation."""
    return tag_terms(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id", WORDS)


@query("SELECT doc_id, source || ' ' || coalesce(text, '') AS text_features FROM documents")
def text_features(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", title_plus_description("source", "text").alias("text_features"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_exists(props, '$.k') AS has_k,
  json_exists(props, '$.missing') AS has_missing FROM events""")
def json_keys(spark, sf_dir):
    """Keys are folded, read back and tested for presence."""
    rows = table(spark, sf_dir, "events").select("event_id", record_fields("props").alias("fields"))
    return rows.select("event_id", text_of(field_sql("k")).alias("k"), has_field("k").alias("has_k"),
                       has_field("missing").alias("has_missing"))


TEXT_CASES = """CASE c_custkey % 9 WHEN 0 THEN '{" V ": {"display_name": "", "name": " ' || c_name || ' "}}'
  WHEN 1 THEN '{"v": "  ' || c_name || ' "}' WHEN 2 THEN '{"v": null}' WHEN 3 THEN '{"v": ' || cast(c_custkey AS string) || '}'
  WHEN 4 THEN '{"v": {"value": ' || cast(c_custkey AS string) || '}}' WHEN 5 THEN '{"V": "old", "v": {"display_name": 0, "title": "T"}}'
  WHEN 6 THEN '{}' WHEN 7 THEN '{"v": true}' ELSE '{"v": {"other": 1}}' END"""


@query("""SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 2 THEN ''
  WHEN 3 THEN cast(c_custkey AS varchar) WHEN 4 THEN cast(c_custkey AS varchar) WHEN 5 THEN 'T' WHEN 6 THEN ''
  WHEN 7 THEN 'True' ELSE '{"other":1}' END AS v FROM customer""")
def polymorphic_text(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", record_fields(TEXT_CASES).alias("fields"))
    return rows.select("c_custkey", text_of(field_sql("v")).alias("v"))


# ---- the whole chain --------------------------------------------------------------------------------------------------

STORED = lambda x: f"cast(cast(({x}) AS varchar) AS decimal(12,2))"  # noqa: E731  rounds the shortest decimal form
HALF_EVEN = lambda x: f"cast(round_even({x}, 0) AS int)"

CHECKED = RAW + f""", parts AS (SELECT id, trim(title) AS title, trim(description) AS description,
  CASE WHEN trim(company) = '' THEN 'Unknown' ELSE trim(company) END AS company_name,
  CASE WHEN trim(place) <> '' THEN trim(string_split(place, ',')[1]) END AS city,
  CASE WHEN trim(place) <> '' THEN trim(string_split(place, ',')[2]) END AS region,
  CASE country_key WHEN 'absent' THEN 'India' ELSE country END AS country, salary_case,
  {SALARY_MIN} AS s_min, {SALARY_MAX} AS s_max FROM raw),
rated AS (SELECT *, {CURRENCY} AS currency FROM parts),
usd AS (SELECT *, s_min * {RATE} AS u_min, s_max * {RATE} AS u_max FROM rated),
checked AS (SELECT id, title, description, company_name, city, region, country,
  cast(s_min AS decimal(10,2)) AS salary_min, cast(s_max AS decimal(10,2)) AS salary_max,
  {HALF_EVEN(YEARS_MIN)} AS experience_min, {HALF_EVEN(YEARS_MAX)} AS experience_max,
  {ROLE} AS job_category, {MODE} AS is_remote, currency AS salary_currency,
  {STORED('u_min')} AS salary_min_usd, {STORED('u_max')} AS salary_max_usd,
  {STORED('(u_min + u_max) / 2.0')} AS salary_mid_usd,
  CASE WHEN title = '' THEN 'blank title' WHEN salary_case = 6 THEN 'salary is not a number' END AS reason FROM usd)
"""
MONEY_COLUMNS = ("salary_min", "salary_max", "salary_min_usd", "salary_max_usd", "salary_mid_usd")
MONEY_AS_DOUBLE = ", ".join(f"cast({name} AS double) AS {name}" for name in MONEY_COLUMNS)


@query(CHECKED + f"SELECT * REPLACE ({MONEY_AS_DOUBLE}) FROM checked")
def checked_postings(spark, sf_dir):
    checked = check_records(posting_records(spark, sf_dir))
    return checked.select(
        F.col("ordinal").alias("id"), "title", "description", "company_name", "city", "region", "country",
        "salary_min", "salary_max", "experience_min", "experience_max", "job_category", "is_remote",
        "salary_currency", "salary_min_usd", "salary_max_usd", "salary_mid_usd", "reason",
    ).withColumns({name: F.col(name).cast("double") for name in MONEY_COLUMNS})


@query(CHECKED + "SELECT reason, count(*) AS records FROM checked WHERE reason IS NOT NULL GROUP BY reason")
def quarantine_reasons(spark, sf_dir):
    return quarantine_counts(check_records(posting_records(spark, sf_dir)))


@query(CHECKED + """SELECT count(*) AS records_read, count(*) FILTER (reason IS NULL) AS inserted,
  count(*) FILTER (reason IS NOT NULL) AS skipped FROM checked""")
def load_counts(spark, sf_dir):
    return load_report(check_records(posting_records(spark, sf_dir)))


@query("SELECT l_orderkey, l_linenumber, cast(round_even(l_quantity / 2.0, 0) AS int) AS years FROM lineitem")
def store_rounding(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", whole_years(F.col("l_quantity") / 2.0).alias("years"))
