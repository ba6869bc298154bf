"""Functions that need Python, all by Arrow batches: for what the built-in functions can't express."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType


@F.pandas_udf(StringType())
def without_accents(texts: pd.Series) -> pd.Series:
    """Letters without their accents (canonical decomposition, combining marks dropped); null stays null. A batch decomposes each
    different text once."""
    known = {t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)) for t in texts.dropna().unique()}
    return pd.Series([known.get(t) for t in texts], dtype=object)


@F.pandas_udf(DoubleType())
def edit_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """The Jaro similarity of two texts, which built-in functions don't have; null where one is null."""
    return pd.Series([None if x is None or y is None else _jaro(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _jaro(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach, taken, order = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                order.append(c)
                break
    if not order:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(order, other, strict=True)) // 2
    return (len(order) / len(a) + len(order) / len(b) + (len(order) - moved) / len(order)) / 3


def resampled(df: DataFrame, step_seconds: int, time: str, value: str, keep: str) -> DataFrame:
    """Per batch of Arrow rows, the Unix step that each time falls in and the value's mantissa and exponent, beside ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(1).cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False)
            fraction, exponent = np.frexp(b.column(2).to_numpy(zero_copy_only=False))
            missing = np.isnan(fraction)
            step = pa.array(np.floor_divide(np.nan_to_num(at), step_seconds * 1_000_000).astype(np.int64), mask=np.isnan(at.astype(float)))
            yield pa.RecordBatch.from_arrays([b.column(0), step, pa.array(fraction, mask=missing), pa.array(exponent.astype(np.int32), mask=missing)], names=[keep, "step", "fraction", "exponent"])

    return df.select(keep, F.col(time).cast("timestamp_ntz"), F.col(value).cast("double")).mapInArrow(run, f"`{keep}` {df.schema[keep].dataType.simpleString()}, step long, fraction double, exponent int")


@F.udtf(returnType=StructType().add("word", StringType()).add("at", IntegerType()))
class Words:
    """Rows of a text's words, for ``LATERAL`` in SQL."""

    def eval(self, text: str):
        for k, w in enumerate((text or "").split()):
            yield w, k
