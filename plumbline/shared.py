"""Storage that the driver and every executor can see."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.errors import PlumblineError

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as spark.checkpoint.dir names it.

    A session on one machine without that setting (a test) gets a folder under the
    machine's temp folder, which is then the checkpoint folder of the session too. On a
    cluster that would be another folder for each executor, so the setting is asked for.
    """
    named = spark.conf.get(_KEY, None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise PlumblineError(f"set {_KEY} to a folder that the driver and all executors share")
        named = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        spark.conf.set(_KEY, named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _store(spark: SparkSession, path: str):
    """A path and its file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; it is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/plumbline-{what}-{uuid.uuid4().hex}"
    hadoop, store = _store(spark, path)
    store.deleteOnExit(hadoop)
    return path


def _written(df: DataFrame) -> str | None:
    """Where the rows of a ``durable`` frame lie."""
    plan = df._jdf.queryExecution().logical()
    if plan.nodeName() != "Scan ExistingRDD" and "LogicalRDD" not in plan.getClass().getName():
        return None
    found = plan.rdd().getCheckpointFile()
    return found.get() if found.isDefined() else None


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder: its lineage is cut, and a lost executor loses nothing.

    The files are deleted by ``release``, or when the session's JVM ends.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(True)
    if path := _written(out):
        hadoop, store = _store(spark, path)
        store.deleteOnExit(hadoop)
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of a ``durable`` frame that nothing will read again."""
    if path := _written(df):
        hadoop, store = _store(df.sparkSession, path)
        store.delete(hadoop, True)
