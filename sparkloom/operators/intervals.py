"""Joins on intervals: points in intervals, and overlaps of two interval tables, as equi-joins without a nested loop.

Quantiles of the points make 8 ** LEVELS * TOPS bins at most; eight bins make one of the level above. An interval takes the
bins that it covers: fine ones near its ends, wide ones between, so a long interval takes few; a point lies in one bin
of each level. A point and an interval share one bin at most, so no pair comes twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import parts

#: Levels of bins, each eight times as wide as the one before.
LEVELS = 4


def _run(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _covering(low: Column, high: Column) -> Column:
    """(level, bin) of the bins that cover the fine bins low..high, each fine bin by one."""

    def named(level: int):
        return lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin"))

    out = []
    for level in range(LEVELS):
        if level == LEVELS - 1:
            own = _run(low, high)
        else:
            up, down = F.ceil(low / 8).cast("int"), (F.floor((high + 1) / 8) - 1).cast("int")
            wide = up <= down
            own = F.when(wide, F.concat(_run(low, up * 8 - 1), _run((down + 1) * 8, high))).otherwise(_run(low, high))
            low, high = F.when(wide, up).otherwise(1), F.when(wide, down).otherwise(0)
        out.append(F.transform(own, named(level)))
    return F.flatten(F.array(*out))


def points_in_intervals(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, by: list[tuple[str, str]] | None = None, open_low: bool = False, rows_per_bin: int = 2_000) -> DataFrame:
    """Columns of both for each point with low <= point < high (low < point with ``open_low``), and equal in the pairs of
    columns ``by``. Any type that can be ordered; a null point, bound or key matches nothing, nor does an empty interval.
    The two tables have no column name in common."""
    common = {c.lower() for c in points.columns} & {c.lower() for c in intervals.columns}
    if common:
        raise ValueError(f"{', '.join(sorted(common))}: columns of both sides; rename them")
    column = parts.column
    x, l, h = column(point), column(low), column(high)
    bins, level, at, end = (parts.fresh(n, points, intervals) for n in ("bins", "level", "bin", "end"))
    cuts = parts.cuts(points.filter(x.isNotNull()), x, rows_per_bin)
    p = parts.number(points.filter(x.isNotNull()), x, cuts, at)
    p = p.withColumn(bins, F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(F.col(at), 3 * k).alias("bin")) for k in range(LEVELS)))))
    i = parts.number(parts.number(intervals.filter(l < h), l, cuts, at), h, cuts, end)
    i = i.withColumn(bins, F.explode(_covering(F.col(at), F.col(end))))
    p, i = (df.withColumns({level: F.col(bins)["level"], at: F.col(bins)["bin"]}).drop(bins) for df in (p, i))
    i = i.drop(end).withColumnsRenamed({level: level + "_i", at: at + "_i"})
    on = (F.col(level) == F.col(level + "_i")) & (F.col(at) == F.col(at + "_i"))
    for a, b in by or []:
        on = on & (column(a) == column(b))
    return p.join(i, on & ((x > l) if open_low else (x >= l)) & (x < h)).drop(level, at, level + "_i", at + "_i")


def overlap_join(left: DataFrame, right: DataFrame, left_low: str, left_high: str, right_low: str, right_high: str, by: list[tuple[str, str]] | None = None, rows_per_bin: int = 2_000) -> DataFrame:
    """Columns of both for each pair of intervals [low, high) that overlap, and are equal in the pairs of columns ``by``.

    Of two overlapping intervals the later start lies in the other one, so each pair comes once: where the right one starts
    within the left one, or where the left one starts later within the right one. Empty intervals and null bounds overlap
    nothing."""
    column = parts.column
    l, r = left.filter(column(left_low) < column(left_high)), right.filter(column(right_low) < column(right_high))
    turned = [(b, a) for a, b in by or []]
    starts = points_in_intervals(r, l, right_low, left_low, left_high, turned, False, rows_per_bin)
    later = points_in_intervals(l, r, left_low, right_low, right_high, by, True, rows_per_bin)
    return starts.select(*(column(c) for c in (*left.columns, *right.columns))).unionByName(later)
