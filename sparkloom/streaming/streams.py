"""Streams over event tables, and a way to run one to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.sources import shared


def in_files(events: DataFrame, time: str, files: int) -> str:
    """The table as ``files`` files in order of ``time``, one written after the other, so that a file stream takes them in
    that order; a row without a time comes in the first. For replays of what is at rest."""
    spark = events.sparkSession
    path = shared.new_path(spark, "replay")
    seconds = F.col(time).cast("timestamp").cast("long")
    low, high = events.agg(F.min(seconds), F.max(seconds)).head()
    part = F.floor((seconds - (low or 0)) * files / max(1, (high or 0) - (low or 0) + 1))
    for k in range(files):
        events.filter(F.coalesce(part, F.lit(0)) == k).coalesce(1).write.mode("append").parquet(path)
    return path


def events(spark: SparkSession, folder: str, pattern: str = "*.parquet", lateness: str = "1 hour") -> DataFrame:
    """A file stream, one file a batch, whose ``ts`` carries a watermark (which asks for a timestamp with a zone)."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def finished(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run the stream over all that is there and give what it wrote: all rows of ``append`` and ``update``, the last state of
    ``complete``. With the same ``checkpoint`` and ``out``, a later call goes on where this one ended."""
    spark = stream.sparkSession
    checkpoint, out = checkpoint or shared.new_path(spark, "stream-state"), out or shared.new_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:  # a batch that runs again replaces its own folder
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(stream.schema).parquet(out)
    return got.select(*stream.columns)


def sliding(events: DataFrame, width: str, slide: str) -> DataFrame:
    return events.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("win_start"), "n")


def first_of(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key within the watermark's lateness; the state is dropped as the watermark passes."""
    return events.dropDuplicatesWithinWatermark(keys)


def first_ever(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key, however long ago it came; the state holds every key there has been."""
    return events.dropDuplicates(keys)


def within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, width: str) -> DataFrame:
    """Pairs of one key whose right row comes at most ``width`` after the left one. The bound lets both states be dropped."""
    near = (F.col(f"l.{key}") == F.col(f"r.{key}")) & F.expr(f"r.{right_time} >= l.{left_time} AND r.{right_time} <= l.{left_time} + INTERVAL {width}")
    return left.alias("l").join(right.alias("r"), near)


def running_totals(events: DataFrame, key: str, idle: int | None = None) -> DataFrame:
    """Per key the rows seen so far and the last event, kept in a state of its own. With ``idle``, a number of
    milliseconds, a key's state goes once the watermark is so far past its last event, and its count begins anew;
    without, every key stays."""
    wait = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last, at = state.get if state.exists else (0, 0, 0)
        if idle is not None and n and state.getCurrentWatermarkMs() > at + idle:
            n, last, at = 0, 0, 0
        for f in frames:
            n, last, at = n + len(f), max(last, int(f["event_id"].max())), max(at, int(f["ts"].max().timestamp() * 1000))
        state.update((n, last, at))
        if idle is not None:
            state.setTimeoutTimestamp(max(at + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"k": [key[0]], "n": [n], "last_event": [last]})

    return events.groupBy(key).applyInPandasWithState(run, "k long, n long, last_event long", "n long, last long, at long", "update", wait)


def each_batch(stream: DataFrame, use: Callable[[DataFrame], None], checkpoint: str) -> None:
    """Hand every batch to ``use``, at least once."""
    stream.writeStream.foreachBatch(lambda batch, _: use(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
