"""Declared keys, references and domains, checked as a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators.keys import COLLATION
from hirelake.sources.star import Star


def _one_row(label: str, broken: DataFrame) -> DataFrame:
    return broken.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(label).alias("rule"), "violations")


def duplicate_keys(df: DataFrame, keys, label: str, collation: str | None = None) -> DataFrame:
    """Number of key values that occur more than once; with a collation, after folding case and accents."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if collation:
        folds = [F.collate(F.coalesce(F.col(name), F.lit("")), collation).alias(f"_f{i}") for i, name in enumerate(keys)]
        nulls = [F.col(name).isNull().alias(f"_z{i}") for i, name in enumerate(keys)]
        counted = counted.groupBy(*folds, *nulls).agg(F.sum("_n").alias("_n"))
    return _one_row(label, counted.filter("_n > 1"))


def orphans(df: DataFrame, parent: DataFrame, key: str, label: str, parent_key: str | None = None) -> DataFrame:
    """Number of rows whose non-null reference has no parent."""
    parents = parent.select(F.col(parent_key or key).alias(key))
    return _one_row(label, df.filter(F.col(key).isNotNull()).join(parents, key, "left_anti"))


def missing_values(df: DataFrame, name: str, label: str) -> DataFrame:
    return _one_row(label, df.filter(F.col(name).isNull()))


def outside_domain(df: DataFrame, name: str, allowed, label: str) -> DataFrame:
    return _one_row(label, df.filter(F.col(name).isNotNull() & ~F.col(name).isin(list(allowed))))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def integrity_report(star: Star) -> DataFrame:
    """(rule, violations) for every key, reference, required column and domain that the star declares."""
    companies, locations, skills = star.table("companies"), star.table("locations"), star.table("skills")
    postings, links = star.table("job_postings"), star.table("job_skills")
    return report(
        duplicate_keys(companies, ["company_id"], "companies.company_id is unique"),
        duplicate_keys(companies, ["company_name"], "companies.company_name is unique", COLLATION),
        duplicate_keys(locations, ["location_id"], "locations.location_id is unique"),
        duplicate_keys(locations, ["city", "region", "country"], "locations place is unique", COLLATION),
        duplicate_keys(skills, ["skill_id"], "skills.skill_id is unique"),
        duplicate_keys(skills, ["skill_name"], "skills.skill_name is unique", COLLATION),
        outside_domain(skills, "skill_category", ("technical", "soft"), "skills.skill_category is known"),
        duplicate_keys(postings, ["job_id"], "job_postings.job_id is unique"),
        missing_values(postings, "title", "job_postings.title is given"),
        missing_values(postings, "company_id", "job_postings.company_id is given"),
        orphans(postings, companies, "company_id", "job_postings.company_id exists"),
        orphans(postings, locations, "location_id", "job_postings.location_id exists"),
        duplicate_keys(links, ["job_id", "skill_id"], "job_skills pair is unique"),
        orphans(links, postings, "job_id", "job_skills.job_id exists"),
        orphans(links, skills, "skill_id", "job_skills.skill_id exists"),
    )
