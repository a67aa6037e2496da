"""Incremental lake load: every new file exactly once through the batch transforms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.operators.load import load_star
from hirelake.operators.transform import check_records
from hirelake.sources.lake import LAKE_FILES, explode_documents, format_of, line_records, read_lake
from hirelake.sources.sinks import union_batches
from hirelake.sources.star import Star


def stream_files(spark: SparkSession, path: str, fmt: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Streaming (file, value): whole documents for ``json``, lines for ``lines``; without ``fmt`` the files themselves,
    by name alone (their content is not read), of the kinds that a lake holds."""
    if fmt is None:
        schema = "path string, modificationTime timestamp, length long, content binary"
        reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", LAKE_FILES)
    else:
        reader = spark.readStream.format("text").option("wholetext", fmt == "json")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    files = reader.option("recursiveFileLookup", True).load(path)
    if fmt is None:
        return files.select(F.col("path").alias("file"))
    return files.select(F.col("_metadata.file_path").alias("file"), "value")


def batch_records(batch: DataFrame, fmt: str | None = None) -> DataFrame:
    """Records of a micro-batch of :func:`stream_files`. Without ``fmt`` each file is read as its suffix says: JSON as a
    document or JSON Lines, CSV by its own header. Only the names of the batch's new files reach the driver, where the
    file source has them anyway; ``files_per_batch`` bounds them."""
    if fmt is None:
        names = [row["file"] for row in batch.select("file").collect()]
        by_kind = {kind: [name for name in names if format_of(name) == kind] for kind in ("json", "csv")}
        return union_batches(*(read_lake(batch.sparkSession, own, kind) for kind, own in by_kind.items() if own))
    return (explode_documents if fmt == "json" else line_records)(batch)


def run_incremental(spark: SparkSession, path: str, root: str, checkpoint: str, load_date: dt.date,
                    fmt: str | None = None, files_per_batch: int | None = None, **options) -> None:
    """Load everything that arrived since the last run, then stop.

    ``fmt``: ``json`` or ``lines`` reads every file in that way; without it a folder may hold JSON documents, JSON Lines
    and CSV files (.json and .csv, in any case of letters), and files with other names are left alone.

    The file source and the checkpoint decide which files are new. A load is named by the stream's id, which its
    checkpoint keeps, and the batch number: a batch that is repeated after a failure replaces what it left and reuses
    its reserved ids, and streams with checkpoints of their own stay apart in one star.
    """
    if fmt not in (None, "json", "lines"):
        raise ValueError(f"unknown stream format {fmt!r}")
    star = Star(spark, root).create()

    def load(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            if not stream:
                raise RuntimeError("the stream has no id")
            load_star(check_records(batch_records(batch, fmt), **options), star, load_date, f"stream-{stream}-{number:010d}")

    query = (
        stream_files(spark, path, fmt, files_per_batch).writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
