"""State with timers: sessions that are kept only while they can still grow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: A session: its key as text, begin and end (microseconds), rows.
_SPAN = ("k", "begin", "stop", "n")


def _spans(k, begin, stop, n) -> pd.DataFrame:
    return pd.DataFrame({"k": pd.Series(k, dtype=object), "begin": np.asarray(begin, "int64"), "stop": np.asarray(stop, "int64"), "n": np.asarray(n, "int64")})


def _merged(spans: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Spans of a key that lie less than ``gap`` microseconds apart as one."""
    spans = spans.assign(code=pd.factorize(spans["k"])[0]).sort_values(["code", "begin", "stop"], ignore_index=True)
    code, begin, reach = spans["code"].to_numpy(), spans["begin"].to_numpy(), spans.groupby("code")["stop"].cummax().to_numpy()
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (begin[1:] - reach[:-1] >= gap)])
    return _spans(spans["k"].to_numpy()[first], begin[first], np.maximum.reduceat(spans["stop"].to_numpy(), first), np.add.reduceat(spans["n"].to_numpy(), first))


class _Sessions(StatefulProcessor):
    """Open sessions of a bucket of keys as a value of arrays; a timer for the earliest end closes all that are over."""

    def __init__(self, gap: int):
        self.gap = gap  # milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "k array<string>, begin array<long>, stop array<long>, n array<long>")

    def _ends(self, spans: pd.DataFrame) -> pd.Series:
        return spans["stop"] // 1000 + 1 + self.gap

    def _keep(self, spans: pd.DataFrame) -> None:
        if len(spans):
            self.open.update(tuple(spans[c].tolist() for c in _SPAN))
            self.handle.registerTimer(int(self._ends(spans).min()))
        elif self.open.exists():
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = [_spans(*self.open.get())] if self.open.exists() else []
        for frame in rows:
            if len(frame):
                found.append(_merged(_spans(frame["k"].to_numpy(), frame["at"], frame["at"], np.ones(len(frame))), self.gap * 1000))
        for t in [*self.handle.listTimers()]:
            self.handle.deleteTimer(t)
        if found:
            self._keep(_merged(pd.concat(found, ignore_index=True), self.gap * 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spans = _spans(*self.open.get())
        gone = self._ends(spans) <= timerValues.getCurrentWatermarkInMs()
        self._keep(spans[~gone])
        yield spans.loc[gone, ["k", "begin", "n"]]

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, key: str, time: str, gap_seconds: int, buckets: int = 256) -> DataFrame:
    """k, begin, n of each session once the watermark has passed its end and the gap. State holds open sessions only: a
    closed one goes with its timer, so state is bounded by what is within lateness and gap of now. Rows without a time have no session.

    Keys of one of ``buckets`` share a state and a timer, so calls to the state grow with buckets and batches, not with keys
    and sessions; a bucket's open sessions are arrays in a task. Keys go there as text, so they are of a type whose text tells them apart."""
    spark = events.sparkSession
    spark.conf.set(*_STORE)
    kind = events.schema[key].dataType.simpleString()
    rows = events.filter(F.col(time).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("k"), F.col(time), F.unix_micros(time).alias("at"))
    closed = rows.groupBy("bucket").transformWithStateInPandas(_Sessions(gap_seconds * 1000), "k string, begin long, n long", "append", "EventTime")
    return closed.select(F.col("k").cast(kind).alias("k"), F.timestamp_micros("begin").alias("begin"), "n")
