"""The four reports over the star, under their display names.

The headings of the columns are fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions.display import dollars
from hirelake.operators import reports
from hirelake.operators.keys import COLLATION
from hirelake.sources.star import Star


def location_salary_rank(star: Star) -> DataFrame:
    """Places of each category and country by average midpoint salary. The company table adds nothing and is not
    read: every posting has its company (see the integrity report)."""
    placed = star.table("job_postings").join(star.table("locations"), "location_id")
    ranked = reports.dense_rank_by_average(
        placed, ["job_category", "country", "city"], ["job_category", "country"], "salary_mid_usd", COLLATION
    ).orderBy("job_category", "country", "salary_rank")
    return ranked.select(
        F.col("job_category").alias("Job Category"), F.col("country").alias("Country"), F.col("city").alias("City"),
        F.col("posting_count").alias("Postings Count"),
        dollars(F.col("avg_value"), 2).alias("Average Midpoint Salary (USD)"),
        F.col("salary_rank").alias("Salary Rank"),
    )


def posting_volume(star: Star) -> DataFrame:
    """Daily postings of each category with their average over the last seven days that have postings."""
    volume = reports.rolling_volume(star.table("job_postings"), "job_category", "posted_date")
    return volume.orderBy("job_category", F.desc("posted_date")).select(
        F.col("job_category").alias("Job Category"), F.col("posted_date").alias("Posted Date"),
        F.col("daily_postings").alias("Daily Postings"), F.col("rolling_avg").alias("7D Rolling Avg Postings"),
        F.col("days_in_window").alias("Days in Window"),
    )


def top_skills(star: Star, n: int = 5) -> DataFrame:
    """The most frequent skills of each category and skill type."""
    counts = reports.skill_frequencies(star.table("job_postings"), star.table("job_skills"), star.table("skills"))
    ranked = reports.top_n_per_group(counts, ["job_category", "skill_category"], "skill_name", n)
    return ranked.orderBy("job_category", "skill_category", "item_rank").select(
        F.col("job_category").alias("Job Category"), F.col("skill_category").alias("Skill Type"),
        F.col("skill_name").alias("Skill Name"), F.col("frequency").alias("Job Count"),
        F.col("item_rank").alias("Rank"),
    )


def compensation_matrix(star: Star) -> DataFrame:
    """Salaries by work mode and experience bucket."""
    matrix = reports.bucket_matrix(star.table("job_postings"), "is_remote", "experience_min",
                                   "salary_min_usd", "salary_mid_usd", "salary_max_usd")
    return reports.in_bucket_order(matrix, "is_remote").select(
        F.col("is_remote").alias("Work Mode"), F.col("bucket").alias("Experience Bucket"),
        F.col("total_listings").alias("Total Listings"),
        dollars(F.col("min_value"), 0).alias("Min Salary (USD)"),
        dollars(F.col("avg_value"), 0).alias("Avg Midpoint Salary (USD)"),
        dollars(F.col("max_value"), 0).alias("Max Salary (USD)"),
    )
