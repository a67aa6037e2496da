"""API payloads → flat raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import rules
from hirelake.functions.text import numeric_kind_sql, quoted, strip


def market_country(code: Column) -> Column:
    """Country of a market code; every code without an own entry belongs to the other market."""
    chain = F
    for key, country in rules.MARKET_COUNTRIES.items():
        chain = chain.when(code == key, country)
    return chain.otherwise(rules.OTHER_MARKET_COUNTRY)


def salary_display(low: Column, high: Column) -> Column:
    """'low - high', 'low' or 'N/A'; null, zero and empty count as missing, a lone maximum is not shown.

    ``low`` and ``high`` are texts as they stand in the payload.
    """
    def given(amount: Column) -> Column:
        return (F.coalesce(amount, F.lit("")) != "") & ~(F.coalesce(amount.try_cast("double"), F.lit(1.0)) == 0)

    return (
        F.when(given(low) & given(high), F.concat(low, F.lit(" - "), high))
        .when(given(low), low)
        .otherwise(rules.MISSING)
    )


def scrape_stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def parse_results(payload: Column) -> Column:
    """array<string>: JSON text of each entry of ``results``; null when the payload has no such list."""
    return F.from_json(payload, "results array<string>")["results"]


def _text_or(path: str, default: str) -> Column:
    """Text of a member of ``_job``; the default replaces only an absent member."""
    item = f"try_variant_get(_job, {quoted(path)}, 'variant')"
    return F.expr(f"CASE WHEN {item} IS NULL THEN {quoted(default)} ELSE cast({item} AS string) END")


def _broken_sql(path: str, kind: str) -> str:
    """Is the member present, but not of ``kind`` (an explicit null included)?"""
    item = f"try_variant_get(_job, {quoted(path)}, 'variant')"
    return f"({item} IS NOT NULL AND NOT startswith(schema_of_variant({item}), '{kind}'))"


def _amount(path: str) -> Column:
    item = f"try_variant_get(_job, {quoted(path)}, 'variant')"
    kind = f"schema_of_variant({item})"
    return F.expr(f"CASE WHEN {numeric_kind_sql(kind)} OR {kind} = 'STRING' THEN cast({item} AS string) END")


def flatten_payload(df: DataFrame, payload_col: str, market_col: str, batch_ts: Column):
    """(good, quarantine) raw records of landed payload texts, one row per entry of ``results``.

    A missing member takes its default, an explicit null title, company, place or description breaks the entry.
    """
    entries = F.posexplode_outer(parse_results(F.col(payload_col))).alias("_place", "_text")
    jobs = df.select(F.col(market_col).alias("_market"), entries).filter(F.col("_place").isNotNull())
    jobs = jobs.select("_market", "_text", F.try_parse_json("_text").alias("_job"))
    broken = " OR ".join((
        "_job IS NULL", "NOT startswith(schema_of_variant(_job), 'OBJECT')",
        _broken_sql("$.title", "STRING"), _broken_sql("$.description", "STRING"),
        _broken_sql("$.company", "OBJECT"), _broken_sql("$.company.display_name", "STRING"),
        _broken_sql("$.location", "OBJECT"),
        f"({_broken_sql('$.location.area', 'ARRAY')} AND {_broken_sql('$.location.area', 'VOID')})",
    ))
    areas = "try_variant_get(_job, '$.location.area', 'array<string>')"
    members = jobs.select(
        "_market", F.col("_text").alias("_raw"),
        F.expr(f"coalesce({broken}, true)").alias("_broken"),
        _text_or("$.title", rules.MISSING).alias("title"),
        _text_or("$.company.display_name", rules.MISSING).alias("company"),
        F.expr(f"coalesce(try_element_at({areas}, -1), {quoted(rules.MISSING)})").alias("location"),
        _text_or("$.description", rules.MISSING_DESCRIPTION).alias("description"),
        _amount("$.salary_min").alias("_low"), _amount("$.salary_max").alias("_high"),
        _text_or("$.redirect_url", "").alias("source_url"),
    )
    flat = members.select(
        "_broken", "_raw",
        strip("title").alias("title"),
        strip("company").alias("company"),
        "location",
        market_country(F.col("_market")).alias("country"),
        strip("description").alias("description"),
        salary_display(F.col("_low"), F.col("_high")).alias("salary"),
        F.col("_low").try_cast("double").alias("salary_min"),
        F.col("_high").try_cast("double").alias("salary_max"),
        "source_url",
        scrape_stamp(batch_ts).alias("scraped_at"),
    )
    good = flat.filter(~F.col("_broken")).drop("_broken", "_raw")
    return good, flat.filter("_broken").select(F.col("_raw").alias("record"))
