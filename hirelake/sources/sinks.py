"""Sinks: raw lake (JSON Lines by ingest date) and CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_raw_lake(df: DataFrame, path: str, ingest_date: str) -> str | None:
    """Append a batch to the lake as JSON Lines under ``ingest_date=…``; an empty batch writes nothing.

    Null members are kept, so that present-but-null survives the round trip.
    """
    if df.isEmpty():
        return None
    folder = f"{path.rstrip('/')}/ingest_date={ingest_date}"
    df.write.mode("append").option("ignoreNullFields", False).json(folder)
    return folder


def export_csv(df: DataFrame, path: str) -> str:
    """All columns with a header and no index, in as many part files as the result has partitions."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    return path


def union_batches(*batches: DataFrame) -> DataFrame:
    """Bag union by name of page batches; columns that a batch lacks become null."""
    first, *rest = batches
    for batch in rest:
        first = first.unionByName(batch, allowMissingColumns=True)
    return first


def quarantine_counts(checked: DataFrame, reason: str = "reason") -> DataFrame:
    """How many records were set aside, by reason."""
    return checked.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("records"))
