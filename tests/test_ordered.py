"""Scans, as-of joins, intervals and sliding frames on hot keys, nulls, ties and clashing names, in many small parts."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import intervals, parts, scan, sliding
from sparkloom.plans import ordered
from tests.oracle import rows_of


def plan_of(df):
    return df._jdf.queryExecution().toString()


def same(df, tables, sql):
    """``tables``: name -> Spark table, small; compared with DuckDB's answer."""
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(f"{name}_", t.toArrow())
        con.sql(f"CREATE TABLE {name} AS SELECT * FROM {name}_")
    got = con.sql(sql)
    assert sorted(df.columns) == sorted(got.columns)
    a, b = rows_of(df.columns, df.collect()), rows_of(list(got.columns), got.fetchall())
    assert a == b, (list((a - b).items())[:5], list((b - a).items())[:5])


@pytest.fixture(scope="module")
def hot(spark):
    """2,000 rows, nine of ten of one key, with nulls, ties and the names that the operators use inside."""
    random.seed(5)
    rows = [(1 if random.random() < 0.9 else random.choice([2, 3, None]), random.choice([None, *range(40)]), i, random.choice([None, 1, 2, 3, 5, 8]), "x", i % 7) for i in range(2000)]
    return spark.createDataFrame(rows, "k int, t int, i int, part int, row string, at int").repartition(5).cache()


KINDS = {"s": ("sum", "part"), "c": ("count", "part"), "lo": ("min", "part"), "hi": ("max", "part"), "la": ("last", "part"), "lg": ("lag", "part"), "n": ("row_number",), "r": ("rank",), "d": ("dense_rank",)}
WANT = """SELECT *, CAST(sum(part) OVER w AS BIGINT) AS s, count(part) OVER w AS c, min(part) OVER w AS lo, max(part) OVER w AS hi, last_value(part IGNORE NULLS) OVER w AS la, lag(part) OVER w AS lg, row_number() OVER w AS n,
    rank() OVER p AS r, dense_rank() OVER p AS d FROM hot WINDOW p AS ({by} ORDER BY t NULLS FIRST), w AS ({by} ORDER BY t NULLS FIRST, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@pytest.mark.parametrize("rows", [37, 400, 10_000])
def test_scan_with_and_without_key(spark, hot, rows):
    same(scan.prefix_scan(hot, ["t"], KINDS, ["k"], ["i"], rows), {"hot": hot}, WANT.format(by="PARTITION BY k"))
    whole = scan.prefix_scan(hot, ["t"], KINDS, None, ["i"], rows)
    same(whole, {"hot": hot}, WANT.format(by=""))
    assert "SinglePartition" not in plan_of(whole)


def test_parts_are_even_though_a_key_is_hot(spark, hot):
    key = F.struct("k", "t", "i")
    sizes = [r["count"] for r in parts.number(hot, key, parts.cuts(hot, key, 100), "p").groupBy("p").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 200 and sum(sizes) == 2000


def test_scan_of_nothing_and_bad_names(spark, hot):
    assert scan.prefix_scan(hot.limit(0), ["t"], KINDS, ["k"], ["i"]).count() == 0
    with pytest.raises(ValueError):
        scan.prefix_scan(hot, ["t"], {"i": ("row_number",)})
    with pytest.raises(ValueError):
        scan.prefix_scan(hot, ["t"], {"x": ("median", "part")})


@pytest.mark.parametrize("rows", [50, 10_000])
def test_asof_on_a_hot_key(spark, hot, rows):
    right = hot.filter("i % 3 = 0").select(F.col("k").alias("k"), F.col("t").alias("since"), F.col("i").alias("seen"))
    joined = scan.asof_join(hot.filter("i % 3 > 0"), right, ["k"], "t", "since", ["seen"], F.lit(1), rows)
    want = """SELECT l.*, CASE WHEN l.t - r.since <= 1 THEN r.seen END AS seen FROM (SELECT * FROM hot WHERE i % 3 > 0) l ASOF LEFT JOIN
        (SELECT k, t AS since, max(i) AS seen FROM hot WHERE i % 3 = 0 AND k IS NOT NULL AND t IS NOT NULL GROUP BY ALL) r ON l.k = r.k AND l.t >= r.since"""
    same(joined, {"hot": hot}, want)


def test_asof_ties_nulls_and_names(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    left = spark.createDataFrame([(1, "a", at(1)), (2, "a", at(5)), (3, "b", at(5)), (4, None, at(5)), (5, "a", None)], "_side int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", at(2), 7), ("a", at(2), 9), ("a", at(5), 1), ("b", at(6), 3), (None, at(1), 7), ("a", None, 8)], "k string, rt timestamp_ntz, v int")
    got = scan.asof_join(left, right, ["k"], "t", "rt", ["v"])
    assert got.columns == ["_side", "k", "t", "v"] and {r[0]: r.v for r in got.collect()} == {1: None, 2: 1, 3: None, 4: None, 5: None}
    two = scan.asof_join(left, right.filter("v <> 1"), ["k"], "t", "rt", ["v"], F.expr("INTERVAL 2 HOURS"))
    assert {r[0]: r.v for r in two.collect()} == {1: None, 2: None, 3: None, 4: None, 5: None}
    with pytest.raises(ValueError):
        scan.asof_join(left, right, ["k"], "t", "rt", ["k"])


def _intervals(spark, n, names, seed):
    random.seed(seed)
    rows = []
    for k in range(n):
        a = random.choice([random.random() * 100, float(random.randrange(100)), 50.0, None])
        rows.append((k, random.choice([1, 2, None]), a, None if a is None or random.random() < 0.05 else a + random.choice([-1, 0, 1e-9, 0.25, 1, 1, 40, 90])))
    return spark.createDataFrame(rows, "{} int, {} int, {} double, {} double".format(*names))


@pytest.mark.parametrize("rows", [2, 50, 10_000])
def test_intervals_of_doubles(spark, rows):
    a, b = _intervals(spark, 500, ("i", "ka", "lo", "hi"), 1), _intervals(spark, 400, ("j", "kb", "from", "to"), 2)
    tables = {"a": a, "b": b}
    overlap = intervals.overlap_join(a, b, "lo", "hi", "from", "to", None, rows)
    same(overlap, tables, 'SELECT * FROM a, b WHERE lo < hi AND "from" < "to" AND lo < "to" AND "from" < hi')
    assert "NestedLoop" not in plan_of(overlap) and "Cartesian" not in plan_of(overlap)
    same(intervals.overlap_join(a, b, "lo", "hi", "from", "to", [("ka", "kb")], rows), tables, 'SELECT * FROM a, b WHERE ka = kb AND lo < hi AND "from" < "to" AND lo < "to" AND "from" < hi')
    points = a.select("i", "lo")
    same(intervals.points_in_intervals(points, b, "lo", "from", "to", rows_per_bin=rows), {"a": points, "b": b}, 'SELECT * FROM a, b WHERE lo >= "from" AND lo < "to"')


def test_range_join_keeps_fractions_dates_and_clashes(spark):
    p = spark.createDataFrame([(8.2,)], "bin double")
    i = spark.createDataFrame([(0.0, 8.5, 1), (8.2, 8.2, 2), (8.5, 8.2, 3), (None, 9.0, 4)], "low double, high double, level int")
    assert [r.level for r in intervals.points_in_intervals(p, i, "bin", "low", "high").collect()] == [1]
    d = lambda day: datetime.date(2024, 1, day)
    days = spark.createDataFrame([(d(k),) for k in range(1, 20)], "d date")
    spans = spark.createDataFrame([(d(3), d(6)), (d(6), d(6))], "a date, b date")
    assert sorted(r.d.day for r in intervals.points_in_intervals(days, spans, "d", "a", "b", rows_per_bin=2).collect()) == [3, 4, 5]
    with pytest.raises(ValueError):
        intervals.overlap_join(i, i, "low", "high", "low", "high")


def test_long_intervals_take_few_bins(spark):
    """A thousand fine bins under one interval make some dozens of rows, not a thousand."""
    p = spark.range(10_000).select(F.col("id").cast("double").alias("x"))
    bins = intervals._covering(F.lit(3).cast("int"), F.lit(4000).cast("int"))
    got = spark.range(1).select(F.explode(bins).alias("b")).select("b.*").collect()
    assert len(got) < 40 and sorted(x for r in got for x in range(r.bin * 8**r.level, (r.bin + 1) * 8**r.level)) == list(range(3, 4001))
    one = spark.createDataFrame([(-5.0, 20_000.0)], "a double, b double")
    assert intervals.points_in_intervals(p, one, "x", "a", "b", rows_per_bin=10).count() == 10_000


def test_sliding_frames(spark, hot, rows=60):
    named = "(SELECT *, row_number() OVER (PARTITION BY k ORDER BY t NULLS FIRST, i) AS nr FROM hot)"
    frame = "PARTITION BY k ORDER BY nr ROWS BETWEEN 11 PRECEDING AND CURRENT ROW"
    span = "PARTITION BY k ORDER BY t RANGE BETWEEN 2 PRECEDING AND CURRENT ROW"
    cols = 'k, t, i, part, row, "at"'
    same(sliding.distinct_in_rows(hot, ["k"], ["t", "i"], "part", 11, "n", rows), {"hot": hot}, f"SELECT {cols}, count(DISTINCT part) OVER ({frame}) AS n FROM {named}")
    same(sliding.distinct_in_range(hot, ["k"], "t", "part", F.lit(2), "n", rows), {"hot": hot}, f"SELECT {cols}, count(DISTINCT part) OVER ({span}) AS n FROM hot")
    same(sliding.median_in_rows(hot, ["k"], ["t", "i"], "part", 11, "n", rows // 2, rows), {"hot": hot}, f"SELECT {cols}, median(CAST(part AS DOUBLE)) OVER ({frame}) AS n FROM {named}")
    same(sliding.median_in_range(hot, ["k"], "t", "part", F.lit(2), "n", rows // 2, rows), {"hot": hot}, f"SELECT {cols}, CASE WHEN t IS NOT NULL THEN median(CAST(part AS DOUBLE)) OVER ({span}) END AS n FROM hot")


def test_ordered_queries_read_whole_tables():
    assert {f.__name__ for f in ordered.ORDERED} == set(ordered.ORACLE)


def test_rows_do_not_carry_the_cuts(spark):
    """What goes to the shuffle grows with rows, not with rows times parts: the scan has no cuts in its plan, joins have them as a constant."""
    df = spark.range(20_000).select((F.col("id") * 7 % 20_000).alias("x"), F.col("id").alias("v"))
    scanned = scan.prefix_scan(df, ["x"], {"n": ("row_number",)}, None, None, 10)
    assert "scalar-subquery" not in plan_of(scanned) and scanned.filter("n <> x + 1").count() == 0
    numbered = parts.number(df, F.col("x"), parts.cuts(df, F.col("x"), 10), "part")
    assert "scalar-subquery" not in plan_of(numbered) and "Project [x" in plan_of(numbered).split("Optimized Logical Plan")[1]
    sizes = {r["part"]: r["count"] for r in numbered.groupBy("part").count().collect()}
    assert len(sizes) == 2000 and max(sizes.values()) < 60
