"""Samples that come out the same at every run and on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import parts


def share_of_one(key: Column, seed: int) -> Column:
    """A number in (0, 1] from the md5 of ``<seed>:<key>``: 52 bits, the same in any engine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 1) / F.lit(float(2**52))


def weighted(df: DataFrame, strata: list[str], key: list[str], weight: str | None, k: int, seed: int = 7) -> DataFrame:
    """``k`` rows of each stratum (all, if fewer) without replacement, chances in proportion to ``weight`` (alike without).

    Each row draws an exponential time of its weight's rate from a hash of ``key``, and the k earliest stay: a top-k, which
    prunes on the map side, so a hot stratum sends k rows a task. Null or not positive weights are never drawn; nulls in the
    key count as ``~``; repeated keys draw alike, and ties go by the key."""
    text = F.concat_ws(":", *(F.coalesce(parts.column(c).cast("string"), F.lit("~")) for c in key))
    time, rank = parts.fresh("time", df), parts.fresh("rank", df)
    w = F.lit(1.0) if weight is None else parts.column(weight).cast("double")
    drawn = df.filter(w > 0).withColumn(time, -F.log(share_of_one(text, seed)) / w)
    first = F.row_number().over(Window.partitionBy(*(parts.column(c) for c in strata)).orderBy(time, *(parts.column(c).asc_nulls_first() for c in key)))
    return drawn.withColumn(rank, first).filter(F.col(rank) <= k).drop(time, rank)
