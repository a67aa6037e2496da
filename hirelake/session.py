"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCRATCH = threading.local()


def build_session(app: str = "hirelake", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library is tested under.

    Adaptive execution does the run-time work: it coalesces small shuffle partitions, turns a sort-merge join
    into a broadcast join when the measured side is small, and splits skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{key.replace("__", "."): str(value) for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new, unused path under the folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Where the setting is absent a local master uses a folder in its warehouse; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    path = f"{base.rstrip('/')}/hirelake/{label}-{uuid.uuid4().hex}"
    for folders in getattr(_SCRATCH, "open", ())[-1:]:
        folders.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that this thread takes from :func:`shared_folder` inside are deleted at the end, also after an error.
    What is still needed then has to be written elsewhere before."""
    stack = _SCRATCH.open = getattr(_SCRATCH, "open", [])
    stack.append([])
    try:
        yield
    finally:
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for folder in stack.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def checkpointed(spark: SparkSession) -> None:
    """Have a folder for checkpoints of iterative fits; one that is set already is left as it is."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives executor loss."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the library from where the driver has it.

    A cluster gets the library by ``--py-files`` or its image; there nothing is changed.
    """
    context = spark.sparkContext
    if context.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        known = context.environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
