"""Running values over a whole table or over hot keys: a distributed prefix scan, and the as-of join made of it.

A window without PARTITION BY, or one whose key holds much of the table, is one task. Here each part of the sort order
is its own window; what comes before a part (one row for each part, for only its first key can have begun earlier) is
added up over the parts and joined back. Rows are shuffled by range, kept, and shuffled by part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import parts

_KINDS = ("sum", "count", "min", "max", "last", "lag", "row_number", "rank", "dense_rank")


def prefix_scan(df: DataFrame, order: list[str], out: dict[str, tuple[str, ...]], by: list[str] | None = None, ties: list[str] | None = None, rows_per_part: int = 10_000) -> DataFrame:
    """All columns of ``df`` and the running values ``out``: name -> (kind, column), with the kinds ``sum count min max
    last lag`` over the rows so far (``ROWS UNBOUNDED PRECEDING``; ``last`` is the last that isn't null, ``lag`` the row before)
    and ``row_number rank dense_rank``, which take no column.

    Rows stand in ascending ``order`` (nulls first), rows of one order value by ``ties``; ``rank`` and ``dense_rank`` go by ``order``
    alone. Where order and ties don't tell rows apart, their places are arbitrary, as in a window. Null keys of ``by`` are one
    group. Equal rows in all of ``by``, ``order`` and ``ties`` share a part, so give ``ties`` where one order value is common."""
    by, ties = by or [], ties or []
    for name, (kind, *_) in out.items():
        if kind not in _KINDS:
            raise ValueError(f"{name}: {kind} is none of {', '.join(_KINDS)}")
        if name in df.columns:
            raise ValueError(f"{name} is a column already")
    column = parts.column
    b, o, t = ([f"{c}{k}" for k in range(len(names))] for c, names in (("b", by), ("o", order), ("t", ties)))
    args = {name: column(spec[1]) for name, spec in out.items() if len(spec) > 1}
    values = {name: f"v{k}" for k, name in enumerate(args)}
    work = df.select(
        F.struct(*(column(c) for c in df.columns)).alias("row"), *(column(c).alias(a) for names, aliases in ((by, b), (order, o), (ties, t)) for c, a in zip(names, aliases, strict=True)),
        *(args[name].alias(v) for name, v in values.items()),
    )
    work = parts.dealt(work, [*b, *o, *t], rows_per_part, "part")

    spot = F.struct(*o, *t)
    own = Window.partitionBy("part", *b).orderBy(*o, *t)
    so_far, peers = own.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("part", *b).orderBy(*o)
    # before a part: the parts of the same key, at most one row for each; without keys, of the whole table
    line = Window.partitionBy(*(b or [F.col("part") * 0])).orderBy("part")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)

    totals: dict[str, Column] = {}
    befores: dict[str, Column] = {}
    local: dict[str, Column] = {}
    final: dict[str, Column] = {}
    ranks = [name for name, (kind, *_) in out.items() if kind in ("rank", "dense_rank")]
    for k, (name, (kind, *_)) in enumerate(out.items()):
        a, v, l, before = f"a{k}", F.col(values.get(name, "part")), F.col(f"l{k}"), F.col(f"c{k}")
        if kind in ("sum", "count", "min", "max"):
            f = getattr(F, kind)
            totals[a], local[f"l{k}"] = f(v), f(v).over(so_far)
            befores[f"c{k}"] = (F.sum if kind == "count" else f)(a).over(earlier)
            both = F.least(l, before) if kind == "min" else F.greatest(l, before) if kind == "max" else l + before
            final[name] = F.coalesce(both, l, before)
        elif kind == "last":
            totals[a], local[f"l{k}"] = F.max_by(v, F.when(v.isNotNull(), spot)), F.last(v, ignorenulls=True).over(so_far)
            befores[f"c{k}"] = F.last(a, ignorenulls=True).over(earlier)
            final[name] = F.coalesce(l, before)
        elif kind == "lag":
            totals[a], local[f"l{k}"] = F.max_by(F.struct(v.alias("v")), spot), F.lag(F.struct(v.alias("v"))).over(own)
            befores[f"c{k}"] = F.last(a).over(earlier)
            final[name] = F.coalesce(l, before)["v"]
        elif kind == "row_number":
            totals[a], local[f"l{k}"], befores[f"c{k}"] = F.count(F.lit(1)), F.row_number().over(own), F.sum(a).over(earlier)
            final[name] = F.coalesce(l + before, l.cast("long"))
        else:
            local[f"l{k}"] = (F.rank() if kind == "rank" else F.dense_rank()).over(peers)
            less = F.col("rows_before") - F.when(F.struct(*o).eqNullSafe(F.col("low")), F.col("peers_before")).otherwise(0) if kind == "rank" else F.col("values_before")
            final[name] = l + F.coalesce(less, F.lit(0).cast("long"))

    carry = _carried(work, b, totals, befores, line)
    done = work.withColumns(local) if local else work
    done = _with(done, carry, b)
    if ranks:
        done = _with(done, _peers(work, b, o, line, earlier), b)
    kinds = dict(done.dtypes)
    shown = [final[name].cast("long" if out[name][0] in ("count", "row_number", "rank", "dense_rank") else kinds[f"l{k}"] if out[name][0] != "lag" else kinds[values[name]]).alias(name) for k, name in enumerate(out)]
    return done.select(*(F.col("row")[c].alias(c) for c in df.columns), *shown)


def _carried(work: DataFrame, b: list[str], totals: dict[str, Column], befores: dict[str, Column], line) -> DataFrame:
    """What all earlier parts of a part's first key add up to."""
    sums = work.groupBy(*b, "part").agg(F.lit(1).alias("one"), *(c.alias(n) for n, c in totals.items()))
    known = sums.withColumns({**befores, "nth": F.row_number().over(line)})
    return known.filter("nth > 1").select("part", *b, *befores)


def _peers(work: DataFrame, b: list[str], o: list[str], line, earlier) -> DataFrame:
    """For ranks: rows and distinct order values before a part, and rows before it that are peers of its first."""
    each = work.groupBy(*b, "part", *o).agg(F.count(F.lit(1)).alias("n"))
    value = F.struct(*o)
    ends = each.groupBy(*b, "part").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.max_by("n", value).alias("tail"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values"))
    alike = Window.partitionBy(*(b or [F.col("part") * 0]), "high").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("so_many", F.sum("tail").over(alike)).withColumn("nth", F.row_number().over(line))
    goes_on = (F.col("nth") > 1) & F.lag("high").over(line).eqNullSafe(F.col("low"))
    ends = ends.withColumn("goes_on", goes_on).withColumn("peers_before", F.when(F.col("goes_on"), F.lag("so_many").over(line)).otherwise(0))
    ends = ends.withColumn("rows_before", F.sum("rows").over(earlier))
    joined = F.sum(F.col("goes_on").cast("long")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("values_before", F.sum("values").over(earlier) - joined)
    return ends.filter("nth > 1").select("part", *b, "low", "peers_before", "rows_before", "values_before")


def _with(rows: DataFrame, carry: DataFrame, b: list[str]) -> DataFrame:
    """A part has one row of ``carry`` at most, so it is small by the number of parts; it holds for the part's first key."""
    values = [c for c in carry.columns if c not in ("part", *b)]
    known = F.broadcast(carry.select("part", F.struct(*b, F.lit(1).alias("one")).alias("whose"), *values))
    joined = rows.join(known, "part", "left")
    holds = F.struct(*b, F.lit(1).alias("one")).eqNullSafe(F.col("whose"))
    return joined.withColumns({c: F.when(holds, F.col(c)) for c in values}).drop("whose")


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], tolerance: Column | None = None, rows_per_slice: int = 10_000
) -> DataFrame:
    """All left rows with ``values`` of the right row whose time is the last not after the left time, per key; null where there
    is none, or where it is further back than ``tolerance`` (an interval, or a number where times are numbers).

    The rows of both sides in time order are a prefix scan that carries the last right row, so a key is cut into slices of
    time of about ``rows_per_slice`` rows, and what holds at the end of one is carried into the next. A null key or time
    matches nothing. Equal right times: the largest ``values``, compared in their order."""
    taken = set(left.columns) & set(values)
    if taken:
        raise ValueError(f"{', '.join(sorted(taken))}: columns of the left side too; rename them")
    column = parts.column
    keys, whole = [f"k{i}" for i in range(len(by))], F.struct(*(column(c) for c in left.columns))
    given = None
    for c in (*by, left_time):
        given = column(c).isNotNull() if given is None else given & column(c).isNotNull()
    found = None
    for c in (*by, right_time):
        found = column(c).isNotNull() if found is None else found & column(c).isNotNull()
    kind = F.struct(*(column(c) for c in values))
    r = right.filter(found).select(*(column(c).alias(k) for c, k in zip(by, keys, strict=True)), column(right_time).alias("t"), F.lit(0).alias("side"), F.struct(column(right_time).alias("t"), kind.alias("v")).alias("r"), F.lit(0).cast("long").alias("tie"))
    l = left.filter(given).select(*(column(c).alias(k) for c, k in zip(by, keys, strict=True)), column(left_time).alias("t"), F.lit(1).alias("side"), F.xxhash64(whole).alias("tie"), whole.alias("row"))
    both = l.unionByName(r, allowMissingColumns=True)
    scanned = prefix_scan(both, ["t", "side"], {"last": ("last", "r")}, keys, ["r", "tie"], rows_per_slice).filter("side = 1")
    near = F.col("last").isNotNull() if tolerance is None else F.col("t") - F.col("last.t") <= tolerance
    matched = scanned.select(*(F.col("row")[c].alias(c) for c in left.columns), *(F.when(near, F.col("last.v")[c]).alias(c) for c in values))
    kinds = dict(right.dtypes)
    none = left.filter(~F.coalesce(given, F.lit(False))).select("*", *(F.lit(None).cast(kinds[c]).alias(c) for c in values))
    return matched.unionByName(none)
