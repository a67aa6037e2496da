"""Exploration: facets, search, key figures, frequency tables and distributions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.operators.quantiles import exact_quantiles, with_group_values
from hirelake.session import settle

ALL = "All"
LEVELS = ("entry", "mid", "senior")


def level_filter(years: Column, level: str, low=2, high=5) -> Column:
    """Predicate for below ``low`` / from ``low`` to ``high`` / above ``high``; null never passes."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    return {"entry": years < low, "mid": years.between(low, high), "senior": years > high}[level]


def apply_facets(df: DataFrame, facets: dict[str, str] | None = None, level: str = ALL,
                 years: str = "experience_min", cuts=(2, 5)) -> DataFrame:
    """Equality on every facet that is not ``All`` or None, and an optional experience level."""
    for name, value in (facets or {}).items():
        if value is not None and value != ALL:
            df = df.filter(F.col(name) == value)
    return df if level in (None, ALL) else df.filter(level_filter(F.col(years), level, *cuts))


def facet_values(df: DataFrame, name: str, given: dict[str, str] | None = None) -> DataFrame:
    """Distinct values of a facet, nulls left out; ``given`` limits them by other facets (cities of a country)."""
    return apply_facets(df, given).select(name).dropna().distinct()


def search(df: DataFrame, query: str, columns=("title", "description", "company_name", "city")) -> DataFrame:
    """Rows where the lower-cased query, a regular expression, matches any lower-cased column; null never matches."""
    if not query:
        return df
    pattern = query.lower()
    return df.filter(reduce(or_, [F.coalesce(F.lower(name).rlike(pattern), F.lit(False)) for name in columns]))


def kpis(df: DataFrame, company: str = "company_name", value: str = "salary_mid_usd", mode: str = "is_remote",
         remote: str = "Remote") -> DataFrame:
    """One row: rows, distinct companies, average of the known values, share of remote rows in percent (0 if empty)."""
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("total_postings"),
        F.count_distinct(company).alias("active_companies"),
        F.avg(value).alias("avg_value"),
        F.coalesce(F.try_divide(F.count_if(F.col(mode) == remote) * 100.0, rows), F.lit(0.0)).alias("remote_share"),
    )


def frequency(df: DataFrame, name: str, top: int | None = None, share: bool = False) -> DataFrame:
    """Rows per value, nulls left out, most frequent first and ties by value; optionally the ``top`` or the share."""
    counted = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("postings"))
    if share:
        total = counted.select(F.sum("postings").alias("n")).scalar()
        counted = counted.withColumn("share", F.col("postings") * 100.0 / total)
    ordered = counted.orderBy(F.desc("postings"), name)
    return ordered if top is None else ordered.limit(top)


def recommend_terms(postings: DataFrame, links: DataFrame, skills: DataFrame, category: str, k: int = 8) -> DataFrame:
    """(skill_name, freq): the ``k`` most frequent skills among the postings of one category."""
    wanted = postings.filter(F.col("job_category") == category).select("job_id")
    counted = links.join(wanted, "job_id").groupBy("skill_id").agg(F.count(F.lit(1)).alias("_n"))
    named = counted.join(skills, "skill_id").groupBy("skill_name").agg(F.sum("_n").alias("freq"))
    return named.orderBy(F.desc("freq"), "skill_name").limit(k)


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram (bin, bin_from, bin_to, rows); empty bins are left out, nulls are not counted."""
    known = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_x"))
    bounds = known.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"))).scalar()
    low, width = bounds["lo"], (bounds["hi"] - bounds["lo"]) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("_x") - low) / width), F.lit(bins - 1))).otherwise(0)
    counted = known.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("postings"))
    return counted.select(
        "bin", (low + width * F.col("bin")).alias("bin_from"), (low + width * (F.col("bin") + 1)).alias("bin_to"),
        "postings",
    )


def box_stats(df: DataFrame, group: str, value: str, method: str = "continuous") -> DataFrame:
    """Exact quartiles, fences at 1.5 interquartile ranges, whisker ends and outlier counts per group."""
    quartiles = settle(exact_quantiles(df, value, [0.25, 0.5, 0.75], [group], method=method).select(
        group, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    ), "quartiles")
    spread = (F.col("q3") - F.col("q1")) * 1.5
    fences = quartiles.withColumn("lower_fence", F.col("q1") - spread).withColumn("upper_fence", F.col("q3") + spread)
    x = F.col("_x")
    inside = x.between(F.col("lower_fence"), F.col("upper_fence"))
    rows = df.filter(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_x"))
    return with_group_values(rows, [group], fences).groupBy(group).agg(
        F.count(F.lit(1)).alias("postings"),
        F.min(x).alias("min_value"),
        *[F.first(name).alias(name) for name in ("q1", "median", "q3", "lower_fence", "upper_fence")],
        F.max(x).alias("max_value"),
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def scatter_points(df: DataFrame, years: str = "experience_min", years_max: str = "experience_max",
                   value: str = "salary_mid_usd", keep=("job_category", "title", "company_name", "city", "country")
                   ) -> DataFrame:
    """Rows that have both experience and value, with the point size (upper years, or lower years + 2)."""
    return df.filter(F.col(years).isNotNull() & F.col(value).isNotNull()).select(
        *keep, years, value, F.coalesce(F.col(years_max), F.col(years) + 2).alias("point_size")
    )
