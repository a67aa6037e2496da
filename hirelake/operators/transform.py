"""Raw records → checked posting rows, each either good or carrying the reason it was set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import rules
from hirelake.functions import enrich
from hirelake.functions.text import (
    let_sql, parse_amounts_sql, quoted, split_place_sql, text_of, text_of_sql, title_plus_description,
)
from hirelake.session import settle
from hirelake.sources.lake import field_sql, has_field_sql
from hirelake.sources.star import MAX_DESCRIPTION_BYTES, MAX_LENGTH, MONEY, MONEY_USD


def resolve_salary(fields: str = "fields") -> Column:
    """struct(min, max, bad): the separate keys win if either is present, otherwise the combined text.

    Of a text under a separate key the smallest amount counts, also for the maximum; a missing side takes the other;
    min and max are never swapped.
    """
    low, high, both = (parse_amounts_sql(field_sql(name, fields)) for name in ("salary_min", "salary_max", "salary"))
    separate = let_sql(f"named_struct('low', {low}, 'high', {high})", "s", """named_struct(
      'min', coalesce(s.low.min, s.high.min), 'max', coalesce(s.high.min, s.low.min), 'bad', s.low.bad OR s.high.bad)""")
    either = f"{has_field_sql('salary_min', fields)} OR {has_field_sql('salary_max', fields)}"
    return F.expr(f"CASE WHEN {either} THEN {separate} ELSE {both} END")


def country_of(fields: str = "fields", default: str = rules.DEFAULT_COUNTRY) -> Column:
    """The country as given, untrimmed; only an absent key takes the default."""
    return _given_or("country", default, fields)


def plain_text_of(name: str, fields: str = "fields") -> Column:
    """Text under a key as it is: '' when the key is absent, null when the value is null."""
    return _given_or(name, "", fields)


def _given_or(name: str, default: str, fields: str) -> Column:
    return F.expr(f"CASE WHEN {has_field_sql(name, fields)} THEN cast({field_sql(name, fields)} AS string) "
                  f"ELSE {quoted(default)} END")


def whole_years(years: Column) -> Column:
    """Years as the integer column stores them: half to even, null when out of range."""
    return F.bround(years, 0).try_cast("int")


def evaluate(df: DataFrame, keep, columns: dict[str, Column]) -> DataFrame:
    """``keep`` plus ``columns``, computed once per row whatever is selected or filtered above.

    In a plain projection the optimizer copies an expression to each place that refers to it; parsing and regular
    expressions would run several times per row. A generator is a boundary it does not copy across. The row is built in a
    projection below it, which runs as generated code; a generator that holds the expressions itself interprets them.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*keep, row.alias("_row")).select(*keep, F.inline_outer(F.array("_row")))


def check_records(records: DataFrame, role_rules=rules.ROLE_RULES, mode_rules=rules.MODE_RULES,
                  currency_rules=rules.CURRENCY_RULES, rates=None, terms=None) -> DataFrame:
    """One row per record with all derived columns, ``reason`` (null for a good row) and ``raw`` (the record's text, null
    for a good row).

    No shuffle: the fields are read, features derived, then it is tested what the store takes. Each step is evaluated
    once per row; a filter on the result is not pushed into it (see :func:`evaluate`).
    """
    raw = F.col("raw") if "raw" in records.columns else F.lit(None).cast("string")
    taken = evaluate(records.select("file", "ordinal", "fields", raw.alias("raw")), ["file", "ordinal", "raw"], {
        "_unreadable": F.col("fields").isNull(),
        "title": text_of(field_sql("title")),
        "company": text_of(field_sql("company")),
        "_place": F.expr(let_sql(text_of_sql(field_sql("location")), "place", split_place_sql("place"))),
        "description": text_of(field_sql("description")),
        "country": country_of(),
        "_country_not_text": F.expr(f"schema_of_variant({field_sql('country')}) NOT IN ('STRING', 'VOID')"),
        "source_url": plain_text_of("source_url"),
        "_salary": resolve_salary(),
    })
    texts = evaluate(taken, taken.columns, {
        "_text": title_plus_description("title", "description"),
        "_title": F.lower("title"),
        "_description": F.lower("description"),
    })
    salary = F.col("_salary")
    derived = evaluate(texts, [name for name in texts.columns if name not in ("_title", "_description")], {
        "_years": enrich.years_range("description", "title"),
        "job_category": enrich.role_category("_title", role_rules, folded=True),
        "is_remote": enrich.work_mode("_description", mode_rules, folded=True),
        "_usd": enrich.to_usd("_salary.min", "_salary.max", "country", rates, currency_rules),
        "_folded": enrich.fold_case("_text"),
    })
    shaped = derived.select(
        "file", "ordinal", "title", "description", F.col("raw").alias("_raw"),
        F.when(F.col("company") == "", rules.DEFAULT_COMPANY).otherwise(F.col("company")).alias("company_name"),
        F.col("_place.city").alias("city"),
        F.col("_place.region").alias("region"),
        "country", "source_url",
        salary["min"].try_cast(MONEY).alias("salary_min"),
        salary["max"].try_cast(MONEY).alias("salary_max"),
        whole_years(F.col("_years.min")).alias("experience_min"),
        whole_years(F.col("_years.max")).alias("experience_max"),
        "job_category", "is_remote",
        F.col("_usd.currency").alias("salary_currency"),
        F.col("_usd.min_usd").try_cast(MONEY_USD).alias("salary_min_usd"),
        F.col("_usd.max_usd").try_cast(MONEY_USD).alias("salary_max_usd"),
        F.col("_usd.mid_usd").try_cast(MONEY_USD).alias("salary_mid_usd"),
        enrich.term_hits("_text", "_folded", terms).alias("terms"),
        "_unreadable", "_country_not_text", "_salary", "_usd", "_years",
    )

    def lost(stored: str, source: str) -> Column:
        return F.col(stored).isNull() & F.col(source).isNotNull()

    too_long = F.octet_length("description") > MAX_DESCRIPTION_BYTES
    for name, limit in MAX_LENGTH.items():
        too_long = too_long | (F.char_length(name) > limit)
    out_of_range = (
        lost("salary_min", "_salary.min") | lost("salary_max", "_salary.max")
        | lost("salary_min_usd", "_usd.min_usd") | lost("salary_max_usd", "_usd.max_usd")
        | lost("salary_mid_usd", "_usd.mid_usd")
        | lost("experience_min", "_years.min") | lost("experience_max", "_years.max")
    )
    tests = (
        ("unreadable record", F.col("_unreadable")),
        ("blank title", F.col("title") == ""),
        ("country is not text", F.col("_country_not_text")),
        ("salary is not a number", F.col("_salary.bad")),
        ("text too long", too_long),
        ("number out of range", out_of_range),
    )
    reason = F
    for label, failed in tests:
        reason = reason.when(F.coalesce(failed, F.lit(False)), label)
    checked = shaped.withColumn("reason", reason.otherwise(None))
    return checked.select(
        *[name for name in checked.columns if not name.startswith("_")],
        F.when(F.col("reason").isNotNull(), F.col("_raw")).alias("raw"),
    )


def transform_records(records: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good, quarantine, report). The checked rows are written once, so all three come from a single parse."""
    checked = settle(check_records(records, **options), "checked")
    good = checked.filter(F.col("reason").isNull()).drop("reason")
    return good, checked.filter(F.col("reason").isNotNull()), load_report(checked)


def load_report(checked: DataFrame) -> DataFrame:
    """One row: records read, inserted and skipped."""
    good = F.col("reason").isNull()
    return checked.agg(
        F.count(F.lit(1)).alias("records_read"),
        F.count_if(good).alias("inserted"),
        F.count_if(~good).alias("skipped"),
    )


def tag_terms(df: DataFrame, text_col: str, id_col: str, terms=None) -> DataFrame:
    """(id, term, term_type): one row per dictionary term found in a text, each at most once per row."""
    folded = evaluate(df, [id_col], {"_text": F.col(text_col), "_folded": enrich.fold_case(text_col)})
    return explode_terms(folded.select(id_col, enrich.term_hits("_text", "_folded", terms).alias("_t")), "_t", id_col)


def explode_terms(df: DataFrame, terms_col: str, id_col: str) -> DataFrame:
    """(id, term, term_type). Outer explode plus a null test: a plain explode makes the optimizer push a size test
    of the whole array below the projection, and every text would then be searched twice."""
    hits = df.select(id_col, F.explode_outer(terms_col).alias("_hit")).filter(F.col("_hit").isNotNull())
    return hits.select(id_col, "_hit.term", "_hit.term_type")
