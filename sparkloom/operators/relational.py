"""Operators that Spark SQL has no syntax for, as compositions of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import parts


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark prunes on the map side (WindowGroupLimit)."""
    rank = parts.fresh("rank", df)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k).drop(rank)


def sum_of_others(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Frame sum that excludes the current row; null in a frame of one row."""
    w = Window.partitionBy(*by)
    total = F.sum(value).over(w) - F.col(value)
    return df.withColumn(out, F.when(F.count(value).over(w) > 1, total))


def groups_frame_sum(df: DataFrame, by: list[str], order: str, value: str, preceding: int, out: str) -> DataFrame:
    """A GROUPS frame: the sum over this and ``preceding`` earlier distinct order values."""
    group = parts.fresh("group", df)
    ranked = df.withColumn(group, F.dense_rank().over(Window.partitionBy(*by).orderBy(order)))
    w = Window.partitionBy(*by).orderBy(group).rangeBetween(-preceding, 0)
    return ranked.withColumn(out, F.sum(value).over(w)).drop(group)


def salted_join(left: DataFrame, right: DataFrame, key: str, rows_per_salt: int = 100_000) -> DataFrame:
    """Inner join where a key holds much of the left side: rows of such a key are dealt over as many salts as it has
    ``rows_per_salt``, by their place in the table and not by their values, and its right rows are repeated so often.

    The keys with more than ``rows_per_salt`` rows are few by their definition (rows / ``rows_per_salt``) and go by broadcast,
    so that the left side is shuffled once, already salted."""
    hot, salt = (parts.fresh(n, left, right) for n in ("salts", "salt"))
    heavy = left.groupBy(key).agg(F.count(F.lit(1)).alias(hot)).filter(F.col(hot) > rows_per_salt).select(key, F.ceil(F.col(hot) / rows_per_salt).cast("int").alias(hot))
    heavy = F.broadcast(heavy)
    place = F.pmod(F.monotonically_increasing_id(), F.col(hot)).cast("int")
    l = left.join(heavy, key, "left").withColumn(salt, F.coalesce(place, F.lit(0))).drop(hot)
    r = right.join(heavy, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(hot), F.lit(1)) - 1))).drop(hot)
    return l.join(r, [key, salt]).drop(salt)
