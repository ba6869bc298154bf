"""Parts of a table in its sort order: the common ground of scans, as-of joins and sliding frames.

Rows go to parts by cuts that a sample of the order gives, so a part holds about as many rows as was asked for whatever
the keys are; one key may span many parts. ``dealt`` leaves the cuts to a range partitioning, whose parts are a table in the
shared folder so that every job sees the same ones; ``cuts`` are a constant of the plan, for tables that share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.sources import shared

#: Most parts (the cuts travel with each task), and rows of the sample for each; files of a table of parts, or parts of a file.
MOST, EACH, FILES = 4096, 64, 64


def column(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def fresh(name: str, *taken: DataFrame) -> str:
    """A column name that none of the tables has."""
    used = {c.lower() for df in taken for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def dealt(df: DataFrame, order: list[str], rows_per_part: int, out: str) -> DataFrame:
    """``df`` with ``out``, the number of each row's part in ascending ``order`` (nulls first), as a table in the shared folder."""
    parts = min(MOST, max(1, -(-df.count() // rows_per_part)))
    spread = df.repartitionByRange(parts, *(column(c) for c in order)).withColumn(out, F.spark_partition_id())
    return shared.table(spread.coalesce(max(min(parts, FILES), parts // 16)), "parts")


def cuts(df: DataFrame, key: Column, rows_per_part: int) -> Column:
    """The cuts of ``key`` as a constant array; none for a table of one part. They pass through JSON, which may round a cut: any
    cuts do, as long as all rows see the same ones, in order."""
    keys = df.select(key.alias("x"))
    rows = keys.count()
    parts = min(MOST, -(-rows // rows_per_part)) if rows else 1
    if parts > 1:
        keys = keys.sample(min(1.0, EACH * parts / rows), 7)
    found = F.sort_array(F.collect_list("x"))
    picked = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda k: F.get(F.col("a"), F.floor(k * F.size("a") / parts).cast("int"))))
    one = keys.agg(found.alias("a")).select(F.array_compact(picked if parts > 1 else F.slice("a", 1, 0)).alias("cuts"))
    text = one.select(F.to_json("cuts")).head()[0] if parts > 1 else "[]"
    return F.sort_array(F.from_json(F.lit(text), one.schema["cuts"].dataType))


def number(df: DataFrame, key: Column, at: Column, out: str) -> DataFrame:
    """``out``: the number of cuts not above ``key``, by halving. ``at`` is a constant: as a column, each row would carry all cuts
    and be as large as the number of parts."""
    x = fresh("x", df)
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(MOST.bit_length()))))

    def step(low: Column, half: Column) -> Column:
        fits = (low + half <= F.size(at)) & (F.get(at, low + half - 1) <= F.col(x))
        return F.when(fits, low + half).otherwise(low)

    return df.withColumn(x, key).withColumn(out, F.aggregate(halves, F.lit(0), step)).drop(x)
