"""Buckets, custom orders and formatting used by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake import rules


def dollars(amount: Column, digits: int = 2) -> Column:
    """'$1,234.50'. Rounds half away from zero first, because ``format_number`` rounds half to even."""
    return F.concat(F.lit("$"), F.format_number(F.round(amount, digits), digits))


def range_bucket(value: Column, low=2, high=5, labels=rules.EXPERIENCE_BUCKETS) -> Column:
    """Label for below ``low``, from ``low`` to ``high``, above ``high``, and null."""
    below, between, above, missing = labels
    return (
        F.when(value < low, below).when(value.between(low, high), between).when(value > high, above)
        .otherwise(missing)
    )


def position_in(value: Column, ordered) -> Column:
    """1-based place of ``value`` in a fixed list, 0 when absent; used as a sort key."""
    return F.coalesce(F.array_position(F.array(*[F.lit(item) for item in ordered]), value), F.lit(0))


def point_size(exp_max: Column, exp_min: Column, span: int = 2) -> Column:
    return F.coalesce(exp_max, exp_min + span)
