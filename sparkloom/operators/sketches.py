"""Sketches kept as columns: a row for each group and day, merged later over any range of days without the rows.

``hll`` and ``theta`` count distinct items, ``theta`` also in unions, intersections and differences; ``kll`` answers
quantiles. All three merge, so a day's sketch is made once and each range reads the few rows of its days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the slots of hll and of the entries of theta, and kll's width.
SLOTS, ENTRIES, WIDTH = 12, 14, 200
#: Three standard errors of each estimate, as a share (of ranks for kll). Below its entries theta is exact.
HLL_BOUND, THETA_BOUND, KLL_BOUND = 3 * 1.04 / 2 ** (SLOTS / 2), 3 / 2 ** (ENTRIES / 2), 0.02


def daily(df: DataFrame, by: list[str], time: str, item: str, value: str) -> DataFrame:
    """by.., day, n, hll, theta, kll. Null items and values are left out of their sketches; a null time is a day of its own."""
    return df.groupBy(*by, F.col(time).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(item, F.lit(SLOTS)).alias("hll"), F.theta_sketch_agg(item, F.lit(ENTRIES)).alias("theta"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(WIDTH)).alias("kll"),
    )


def merged(sketches: DataFrame, by: list, where=None) -> DataFrame:
    """by.., n, hll, theta, kll over the rows ``where`` holds."""
    some = sketches if where is None else sketches.filter(where)
    return some.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", F.lit(ENTRIES)).alias("theta"), F.kll_merge_agg_double("kll", F.lit(WIDTH)).alias("kll"))


def in_both(a, b):
    """The estimate of the items that two theta sketches have in common."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def only_in(a, b):
    return F.theta_sketch_estimate(F.theta_difference(a, b))
