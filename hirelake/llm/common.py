"""What several operators share: text columns, Arrow batches cut by size, settled tables, runs of sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.session import reachable, settle, shared_folder

__all__ = ["binary", "bounded", "documents", "new_names", "reachable", "settle", "shared_folder", "sorted_runs", "table"]

#: Text that a task handles at once; a single longer text is handled alone.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """(doc_id, text) of ``df``; a null text counts as empty, further columns are left out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def new_names(df: DataFrame, *wanted: str) -> list[str]:
    """Working column names that ``df`` does not have, whatever its columns are called."""
    taken, names = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def bounded(batches: Iterator[pa.RecordBatch], column: str | Callable[[pa.RecordBatch], pa.Array] = "text",
            limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, sliced so that ``column`` (a name, or how to get it) holds about ``limit`` bytes in each slice, a row
    at least."""
    for batch in batches:
        texts = column(batch) if callable(column) else batch.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def binary(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str], target: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of equal ``keys`` in rows that are sorted by them: (rows, where each run begins and the end).

    Runs are handed on together, about ``target`` rows at a time; the memory is that of the longest run.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def cuts(part: pa.Table) -> np.ndarray:
        new = np.ones(part.num_rows, dtype=bool)
        if part.num_rows > 1:
            new[1:] = False
            for key in keys:
                values = part.column(key).combine_chunks().to_numpy(zero_copy_only=False)
                new[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(new), part.num_rows)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < target:
            continue
        part = pa.Table.from_batches(held)
        at = cuts(part)
        if len(at) > 2:  # the last run may go on in the next batch
            yield part.slice(0, at[-2]), at[:-1]
            part = part.slice(at[-2])
        held, rows = part.to_batches(), part.num_rows
        target = max(target, 2 * rows)
    if rows:
        part = pa.Table.from_batches(held)
        yield part, cuts(part)
