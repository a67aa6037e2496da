"""The four market reports as operators over any table of the right shape.

Each one aggregates first, so that windows run over groups (places, days, terms) and never over fact rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake import rules
from hirelake.functions.display import position_in, range_bucket


def _fold(name: str, collation: str | None) -> Column:
    return F.collate(F.col(name), collation) if collation else F.col(name)


def dense_rank_by_average(df: DataFrame, group_cols, partition_cols, value: str,
                          collation: str | None = None) -> DataFrame:
    """Count and rounded average of ``value`` per group, dense-ranked by that average within ``partition_cols``.

    With a ``collation`` groups that differ only in case or accents are one group, shown in one of its spellings.
    Fact rows are then still combined on plain text; only the few combined rows are grouped by collation.
    """
    group_cols, partition_cols = list(group_cols), list(partition_cols)
    grouped = df.filter(F.col(value).isNotNull()).groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("posting_count"), F.sum(value).alias("_total")
    )
    if collation:
        keys = [_fold(name, collation).alias(f"_k_{name}") for name in group_cols]
        grouped = grouped.groupBy(*keys).agg(
            *[F.min(name).alias(name) for name in group_cols],
            F.sum("posting_count").alias("posting_count"), F.sum("_total").alias("_total"),
        )
        partition = [F.col(f"_k_{name}") for name in partition_cols]
    else:
        partition = [F.col(name) for name in partition_cols]
    averaged = grouped.withColumn("avg_value", F.round(F.col("_total") / F.col("posting_count"), 2))
    rank = F.dense_rank().over(W.partitionBy(*partition).orderBy(F.desc("avg_value")))
    return averaged.select(*group_cols, "posting_count", "avg_value", rank.alias("salary_rank"), *(
        [F.col(f"_k_{name}") for name in partition_cols] if collation else []
    )).drop(*[f"_k_{name}" for name in partition_cols])


def rolling_volume(df: DataFrame, group: str, date: str, rows: int = 7) -> DataFrame:
    """Rows per group and day, with average and count over the last ``rows`` existing days (gaps are not filled)."""
    daily = df.filter(F.col(date).isNotNull()).groupBy(group, date).agg(F.count(F.lit(1)).alias("daily_postings"))
    frame = W.partitionBy(group).orderBy(date).rowsBetween(-(rows - 1), 0)
    return daily.select(
        group, date, "daily_postings",
        F.round(F.avg("daily_postings").over(frame), 2).alias("rolling_avg"),
        F.count(date).over(frame).alias("days_in_window"),
    )


def count_items(df: DataFrame, by, item: str) -> DataFrame:
    return df.groupBy(*by, item).agg(F.count(F.lit(1)).alias("frequency"))


def top_n_per_group(counts: DataFrame, by, item: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent items of each group; ties go by item, so the result does not depend on the run.

    ``counts`` has one row per group and item (see :func:`count_items`). The rank limit is applied before the
    shuffle as well, so each task passes on at most ``n`` rows per group.
    """
    order = W.partitionBy(*by).orderBy(F.desc("frequency"), item)
    ranked = counts.withColumn("item_rank", F.row_number().over(order))
    return ranked.filter(F.col("item_rank") <= n)


def skill_frequencies(postings: DataFrame, links: DataFrame, skills: DataFrame, category: str = "job_category"
                      ) -> DataFrame:
    """(category, skill_category, skill_name, frequency): links are counted by id before names are attached."""
    wanted = postings.filter(F.col(category).isNotNull()).select("job_id", category)
    counted = links.join(wanted, "job_id").groupBy(category, "skill_id").agg(F.count(F.lit(1)).alias("_n"))
    named = counted.join(skills, "skill_id")
    return named.groupBy(category, "skill_category", "skill_name").agg(F.sum("_n").alias("frequency"))


def bucket_matrix(df: DataFrame, mode: str, measure: str, low_value: str, mid_value: str, high_value: str,
                  cuts=(2, 5), labels=rules.EXPERIENCE_BUCKETS) -> DataFrame:
    """Count, minimum, average and maximum per mode and bucket of ``measure``, long form."""
    bucketed = df.filter(F.col(mid_value).isNotNull()).withColumn(
        "bucket", range_bucket(F.col(measure), *cuts, labels=labels)
    )
    return bucketed.groupBy(mode, "bucket").agg(
        F.count(F.lit(1)).alias("total_listings"),
        F.min(low_value).alias("min_value"),
        F.avg(mid_value).alias("avg_value"),
        F.max(high_value).alias("max_value"),
    )


def pivot_matrix(matrix: DataFrame, mode: str, modes, value: str = "avg_value") -> DataFrame:
    """The matrix with one column per mode, a row per bucket; ``modes`` is listed, so no extra pass finds them."""
    return matrix.groupBy("bucket").pivot(mode, list(modes)).agg(F.first(value, ignorenulls=True))


def in_bucket_order(matrix: DataFrame, mode: str, labels=rules.EXPERIENCE_BUCKETS) -> DataFrame:
    return matrix.orderBy(mode, position_in(F.col("bucket"), labels))
