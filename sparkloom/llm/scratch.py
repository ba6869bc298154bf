"""Tables that cut lineage, written where every executor can read them.

The folder is the session's ``spark.checkpoint.dir``, or else the directory set by ``setCheckpointDir``. Only a
session of one machine (master ``local``) may have neither; it then uses a folder of this process, and any other
raises. Tables are Parquet, committed by Spark, so a lost executor costs a rerun of its tasks only. ``passing``
removes working tables whose readers are done; the others must outlive the lazy DataFrames that read them, until
``clear``. Threads that run operators side by side don't see each other's tables.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []
_OWN = threading.local()
_LOCK = threading.Lock()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_HELD: list[str] = []


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def folder(spark: SparkSession) -> str:
    """This application's folder below the shared checkpoint folder, as a full address that tasks may use too."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        with _LOCK:
            if not _FALLBACK:
                _FALLBACK.append(tempfile.mkdtemp(prefix="sparkloom-"))
        base = "file://" + _FALLBACK[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/llm-{context.applicationId}")
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def table(df: DataFrame, name: str, codec: str = "zstd", batch: int | None = None) -> DataFrame:
    """Write ``df`` once and give the reread table. ``batch``: rows that Python functions get at a time, for wide rows."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with batches(spark, batch):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    for paths in getattr(_OWN, "open", ()):
        paths.append(path)
    return out


@contextmanager
def batches(spark: SparkSession, rows: int | None):
    """Python functions that run within get ``rows`` rows at a time; None leaves the session's number. The last of
    several threads within puts the session's number back."""
    if not rows:
        yield
        return
    with _LOCK:
        _HELD.append(spark.conf.get(_BATCH) if not _HELD else _HELD[0])
        spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        with _LOCK:
            usual = _HELD.pop()
            if not _HELD:
                spark.conf.set(_BATCH, usual)


@contextmanager
def passing(spark: SparkSession, keep: int = 1):
    """Tables written within are deleted at the end, but for the last ``keep``. Only for code whose result reads
    those alone."""
    paths: list[str] = []
    if not hasattr(_OWN, "open"):
        _OWN.open = []
    _OWN.open.append(paths)
    try:
        yield paths
    finally:
        _OWN.open.pop()  # a thread's own stack
    for path in paths[: len(paths) - keep]:
        delete(spark, path)


def delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete every table and file of this application."""
    delete(spark, folder(spark))
