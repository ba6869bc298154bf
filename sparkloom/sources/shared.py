"""A folder that all executors share, for results of streams and for files that are written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def store(uri: str):
    """The pyarrow file system of a full address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def new_path(spark: SparkSession, name: str) -> str:
    """A new address below ``spark.checkpoint.dir`` (or the context's checkpoint directory). Only a session of one machine may
    have neither; it uses a folder of this process."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="sparkloom-"))
        base = _OWN[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def table(df, name: str):
    """``df`` written once in the shared folder and read again: for what several later jobs read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
