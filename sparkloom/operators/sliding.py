"""Aggregates over sliding frames that Spark refuses in windows or recomputes for each row: distinct count and median.

Distinct count: an occurrence of a value counts from its own place, or from where the frame has left the occurrence
before it, up to where the frame leaves it. Those stretches don't overlap, so the distinct count at a row is the number of
stretches that hold it: a running sum of starts and ends, which ``prefix_scan`` takes over hot keys too.

Median: rows are numbered by a scan and dealt to slices by number, each slice with the earlier rows that its frames reach;
a slice keeps one sorted list that follows the frame.

What several of their jobs read is a table in the shared folder.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources import shared

from . import parts
from .scan import prefix_scan


def _numbered(df: DataFrame, by: list[str], order: list[str], rows_per_part: int) -> tuple[DataFrame, list[str]]:
    """row, the keys k0.., the order values o0.. and at, the row's number in its key."""
    column = parts.column
    keys, places = [f"k{i}" for i in range(len(by))], [f"o{i}" for i in range(len(order))]
    named = df.select(F.struct(*(column(c) for c in df.columns)).alias("row"), *(column(c).alias(k) for c, k in zip((*by, *order), (*keys, *places), strict=True)))
    return shared.table(prefix_scan(named, places[:1], {"at": ("row_number",)}, keys, places[1:], rows_per_part), "numbered"), keys


def distinct_in_rows(df: DataFrame, by: list[str], order: list[str], value: str, preceding: int, out: str, rows_per_part: int = 10_000) -> DataFrame:
    """``out``: COUNT(DISTINCT value) over ROWS BETWEEN ``preceding`` PRECEDING AND CURRENT ROW, by ascending ``order`` (nulls
    first; the first column, then the others), which should tell the rows of a key apart. Null values don't count."""
    numbered, keys = _numbered(df, by, order, rows_per_part)
    return _distinct(df, numbered, keys, F.col("at"), F.col("row")[value], F.lit(preceding), out, rows_per_part)


def distinct_in_range(df: DataFrame, by: list[str], order: str, value: str, preceding: Column, out: str, rows_per_part: int = 10_000) -> DataFrame:
    """``out``: COUNT(DISTINCT value) over RANGE BETWEEN ``preceding`` PRECEDING AND CURRENT ROW, peers included. A row whose
    order is null has its null peers as its frame."""
    column = parts.column
    keys = [f"k{i}" for i in range(len(by))]
    named = df.select(F.struct(*(column(c) for c in df.columns)).alias("row"), *(column(c).alias(k) for c, k in zip(by, keys, strict=True)), column(order).alias("at"))
    dated = _distinct(df, named.filter("at IS NOT NULL"), keys, F.col("at"), F.col("row")[value], preceding, out, rows_per_part)
    rest = named.filter("at IS NULL")
    each = rest.groupBy(*keys).agg(F.count_distinct(F.col("row")[value]).alias("n"))
    other = each.select(*(F.col(k).alias(f"_{k}") for k in keys), "n")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return dated.unionByName(rest.join(other, on).select(*(F.col("row")[c].alias(c) for c in df.columns), F.col("n").alias(out)))


def _distinct(df: DataFrame, rows: DataFrame, keys: list[str], at: Column, value: Column, preceding: Column, out: str, rows_per_part: int) -> DataFrame:
    if out in df.columns:
        raise ValueError(f"{out} is a column already")
    rows = rows.select("row", *keys, at.alias("at"), value.alias("v"))
    seen = prefix_scan(rows.filter("v IS NOT NULL").select(*keys, "v", "at").distinct(), ["at"], {"last": ("lag", "at")}, [*keys, "v"], None, rows_per_part)
    # at one place: what begins there, then the rows, then what ends there and what begins just after it
    overlaps = F.col("last").isNotNull() & (F.col("last") + preceding >= F.col("at"))
    begins = F.struct(F.when(overlaps, F.col("last") + preceding).otherwise(F.col("at")).alias("at"), F.when(overlaps, 2).otherwise(0).alias("turn"), F.lit(1).alias("step"))
    ends = F.struct((F.col("at") + preceding).alias("at"), F.lit(2).alias("turn"), F.lit(-1).alias("step"))
    events = seen.select(*keys, F.explode(F.array(begins, ends)).alias("e")).groupBy(*keys, "e.at", "e.turn").agg(F.sum("e.step").alias("step"))
    events = shared.table(events, "events")
    whole = rows.select("row", *keys, "at", F.lit(1).alias("turn"), F.lit(0).cast("long").alias("step"), F.xxhash64("row").alias("tie"))
    both = whole.unionByName(events, allowMissingColumns=True)
    counted = prefix_scan(both, ["at", "turn"], {"n": ("sum", "step")}, keys, ["tie"], rows_per_part).filter("turn = 1")
    return counted.select(*(F.col("row")[c].alias(c) for c in df.columns), F.col("n").alias(out))


def median_in_rows(df: DataFrame, by: list[str], order: list[str], value: str, preceding: int, out: str, slice_rows: int = 10_000, rows_per_part: int = 10_000) -> DataFrame:
    """``out``: the median (double; the mean of the middle two) of ``value`` over ROWS BETWEEN ``preceding`` PRECEDING AND CURRENT
    ROW. Nulls are left out; null where the frame has no value."""
    numbered, keys = _numbered(df, by, order, rows_per_part)
    return _median(df, numbered.withColumns({"first": F.greatest(F.lit(1), F.col("at") - preceding), "end": F.col("at")}), keys, value, out, slice_rows)


def median_in_range(df: DataFrame, by: list[str], order: str, value: str, preceding: Column, out: str, slice_rows: int = 10_000, rows_per_part: int = 10_000) -> DataFrame:
    """The same over RANGE BETWEEN ``preceding`` PRECEDING AND CURRENT ROW, peers included. Rows whose order is null get null."""
    column = parts.column
    dated = df.filter(column(order).isNotNull())
    spread = parts.fresh("tie", df)
    numbered, keys = _numbered(dated.withColumn(spread, F.xxhash64(*(column(c) for c in df.columns))), by, [order, spread], rows_per_part)
    # a frame's first and last row are counts of the rows before its bounds: bounds and rows in one order, rows counted
    frame = F.array(F.struct((F.col("o0") - preceding).alias("t"), F.lit(0).alias("turn"), F.lit(1).alias("what")), F.struct(F.col("o0").alias("t"), F.lit(2).alias("turn"), F.lit(2).alias("what")))
    bounds = numbered.select(*keys, "at", F.explode(frame).alias("f")).select(*keys, "f.t", "f.turn", "at", "f.what", F.lit(0).alias("one"))
    points = numbered.select(*keys, F.col("o0").alias("t"), F.lit(1).alias("turn"), "at", F.lit(0).alias("what"), F.lit(1).alias("one"))
    counted = prefix_scan(bounds.unionByName(points), ["t", "turn"], {"n": ("sum", "one")}, keys, ["at"], rows_per_part).filter("what > 0")
    frames = counted.groupBy(*keys, "at").agg((F.max(F.when(F.col("what") == 1, F.col("n"))) + 1).alias("first"), F.max(F.when(F.col("what") == 2, F.col("n"))).alias("end"))
    other = frames.withColumnsRenamed({k: f"_{k}" for k in (*keys, "at")})
    on = F.col("at") == F.col("_at")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    framed = shared.table(numbered.join(other, on).select("row", *keys, "at", "first", "end"), "framed")
    got = _median(df, framed, keys, value, out, slice_rows)
    return got.unionByName(df.filter(column(order).isNull()).withColumn(out, F.lit(None).cast("double")))


def _median(df: DataFrame, rows: DataFrame, keys: list[str], value: str, out: str, slice_rows: int) -> DataFrame:
    """``rows``: row, keys, at and the numbers of the frame's first and last row, neither of which ever falls."""
    if out in df.columns:
        raise ValueError(f"{out} is a column already")
    rows = rows.withColumn("slice", F.floor(F.col("at") / slice_rows).cast("int"))
    # the slices that a slice's frames reach, and which of their rows
    reach = rows.groupBy(*keys, "slice").agg(F.min("first").alias("low"), F.max("end").alias("high"))
    reach = reach.withColumn("source", F.explode(F.sequence(F.floor(F.col("low") / slice_rows).cast("int"), F.floor(F.col("high") / slice_rows).cast("int")))).withColumnsRenamed({k: f"_{k}" for k in keys})
    values = rows.select(*keys, F.col("slice").alias("source"), "at", "first", "end", F.col("row")[value].cast("double").alias("v"))
    on = values["source"] == reach["source"]
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    dealt = values.join(reach, on & (F.col("at") >= F.col("low")) & (F.col("at") <= F.col("high"))).select(*keys, "slice", "at", "first", "end", "v")
    kinds = dict(dealt.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "at long", "m double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at", ignore_index=True)
        own = group[group["at"] // slice_rows == group["slice"]]
        base, at, v, present = int(group["at"].iloc[0]), 0, group["v"].to_list(), group["v"].notna().to_list()
        begin, held, medians = 0, [], []
        for first, end in zip((own["first"] - base).to_list(), (own["end"] - base).to_list(), strict=True):
            while at <= end:
                if present[at]:
                    insort(held, v[at])
                at += 1
            while begin < first:
                if present[begin]:
                    held.pop(bisect_left(held, v[begin]))
                begin += 1
            half = len(held) // 2
            medians.append(None if not held else held[half] if len(held) % 2 else (held[half - 1] + held[half]) / 2)
        return own[[*keys, "at"]].assign(m=pd.Series(medians, index=own.index, dtype="float64"))

    found = dealt.groupBy(*keys, "slice").applyInPandas(run, schema).withColumnsRenamed({k: f"_{k}" for k in (*keys, "at")})
    on = F.col("at") == F.col("_at")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(found, on).select(*(F.col("row")[c].alias(c) for c in df.columns), F.col("m").alias(out))
