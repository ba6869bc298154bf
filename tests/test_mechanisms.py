"""Kept sketches, samples, closures, buckets, aggregates in two phases, the ledger and sessions with timers."""

import datetime
import glob
import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import two_phase
from sparkloom.operators import closure, sampling, sketches
from sparkloom.plans import mechanisms
from sparkloom.sources import ledger, shared
from sparkloom.sources.tables import bucketed
from sparkloom.streaming import streams, timed

SF = "/root/testdata/sf0.01"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_sketches_merge_over_any_days(spark):
    """Estimates of merged days lie within their bounds, for sets beyond the exact range of theta; set operations too."""
    day = lambda d: F.lit(datetime.datetime(2024, 1, d))
    rows = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("g"), F.expr("timestampadd(DAY, id % 10, timestamp_ntz'2024-01-01')").alias("t"), (F.col("id") % 50_000).alias("i"), F.col("id").cast("double").alias("v"))

    kept = sketches.daily(rows, ["g"], "t", "i", "v")
    assert kept.count() == 10  # a day has rows of one group
    whole = sketches.merged(kept, []).select(F.theta_sketch_estimate("theta").alias("t"), F.hll_sketch_estimate("hll").alias("h"), F.kll_sketch_get_quantile_double("kll", F.lit(0.3)).alias("q"), "n").head()
    assert whole.n == 60_000 and abs(whole.t - 50_000) <= 50_000 * sketches.THETA_BOUND and abs(whole.h - 50_000) <= 50_000 * sketches.HLL_BOUND
    assert abs(whole.q / 60_000 - 0.3) <= sketches.KLL_BOUND
    first = sketches.merged(kept, [], F.col("day") <= day(4).cast("date")).select(F.theta_sketch_estimate("theta").alias("t"), "n").head()
    assert first.n == 24_000 and abs(first.t - rows.filter("t <= timestamp_ntz'2024-01-04'").select("i").distinct().count()) <= first.t * sketches.THETA_BOUND
    halves = sketches.merged(kept, ["g"])
    a, b = (halves.filter(f"g = '{g}'").select(F.col("theta").alias(g)) for g in ("even", "odd"))
    both = a.crossJoin(b).select(sketches.in_both("even", "odd").alias("i"), sketches.only_in("even", "odd").alias("d")).head()
    assert both.i <= 500 and abs(both.d - 25_000) <= 25_000 * 2 * sketches.THETA_BOUND


def test_sketch_estimates_of_the_clicks(spark):
    clicks = spark.read.parquet(f"{SF}/clicks.parquet")
    exact = {r.kind: r for r in clicks.groupBy("kind").agg(F.count_distinct("client_id").alias("c"), F.count("*").alias("n"), F.collect_list("value").alias("v")).collect()}
    for r in mechanisms.sketch_estimates(spark, SF).collect():
        e = exact[r.kind]
        assert r.n == e.n and r.theta == e.c and abs(r.hll - e.c) <= e.c * sketches.HLL_BOUND + 1
        for q in (25, 50, 75):
            assert abs(sum(v <= r[f"q{q}"] for v in e.v) / len(e.v) - q / 100) <= sketches.KLL_BOUND + 1 / len(e.v)


def test_weighted_samples(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("s"), F.col("id").alias("rank"), F.when(F.col("id") < 6000, 9.0).when(F.col("id") < 19_000, 1.0).when(F.col("id") < 19_500, 0.0).alias("time"))
    one = sampling.weighted(df, ["s"], ["rank"], "time", 300)
    rows = one.collect()
    assert one.columns == df.columns and Counter(r.s for r in rows) == {0: 300, 1: 300, 2: 300} and {r.time for r in rows} == {9.0, 1.0}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sampling.weighted(df.repartition(9), ["s"], ["rank"], "time", 300).collect()))
    assert abs(sum(r.time == 9 for r in rows) / 900 - 54_000 / 67_000) < 0.05
    assert "WindowGroupLimit" in plan_of(one)
    assert sampling.weighted(df, ["s"], ["rank"], None, 10_000).count() == 20_000


def test_closure_with_cycles(spark):
    random.seed(6)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(75)] + [(1, None), (None, 2), (3, 3), (4, 5), (4, 5)]
    df = spark.createDataFrame(edges, "t long, s long")
    to = {}
    for a, b in edges:
        if a is not None and b is not None:
            to.setdefault(a, set()).add(b)
    want = {}
    for a in to:
        at, depth = {a}, 0
        seen = set()
        while at:
            depth += 1
            at = {y for x in at for y in to.get(x, ())} - seen
            seen |= at
            want.update({(a, y, depth): 1 for y in at})
    got = Counter(tuple(r) for r in closure.closure(df, "t", "s").collect())
    assert got == want and closure.closure(df.limit(0), "t", "s").count() == 0
    starts = spark.createDataFrame([(4,), (4,), (None,)], "x long")
    assert Counter(tuple(r) for r in closure.closure(df, "t", "s", starts).collect()) == {k: 1 for k in want if k[0] == 4}


def test_buckets_need_no_exchange(spark):
    a, b = spark.range(1000).select((F.col("id") % 300).alias("k"), "id"), spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    a, b = (bucketed(df, name, shared.new_path(spark, name), 4, ["k"]) for df, name in ((a, "bucket_a"), (b, "bucket_b")))
    joined = a.hint("merge").join(b, "k").groupBy("k").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    assert sum(r.n for r in joined.collect()) == 1000 and "Exchange" not in plan_of(joined)


def test_two_phases_carry_buffers(spark):
    """A group of nine tenths of all rows reaches the merge as one buffer a task."""
    random.seed(7)
    rows = [("hot" if random.random() < 0.9 else random.choice(["a", None]), float(i % 17), float(i * i % 29)) for i in range(3000)]
    rows = [(g, 3 + 2 * x - y + random.random() / 100, x, y) for g, x, y in rows] + [("hot", None, 1.0, 1.0), ("few", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, z double, x double, y double").repartition(6)
    got = {r.g: r.c for r in two_phase.aggregate(df, ["g"], ["z", "x", "y"], two_phase.LeastSquares(), "c").collect()}
    assert set(got) == {"hot", "a", None, "few"} and got["few"] is None
    for g in ("hot", "a", None):
        assert all(abs(p - q) < 0.02 for p, q in zip(got[g], (3, 2, -1)))
    kept = two_phase.GROUPS
    assert kept >= 1 and two_phase.aggregate(df.limit(0), ["g"], ["z", "x"], two_phase.LeastSquares(), "c").count() == 0


def test_ledger_leaves_out_files(spark):
    ledger.register(spark)
    path, schema = shared.new_path(spark, "ledger"), "a long, b string"
    spark.range(0, 1000).select(F.col("id").alias("a"), F.concat(F.lit("x"), F.col("id") % 5).alias("b")).repartitionByRange(10, "a").write.format("ledger").mode("append").option("path", path).save()
    spark.createDataFrame([(None, None)], schema).write.format("ledger").mode("append").option("path", path).save()
    read = lambda: spark.read.format("ledger").schema(schema).option("path", path).load()
    assert read().count() == 1001 and read().rdd.getNumPartitions() == 11
    some = read().filter("a >= 250 AND a < 260")
    assert some.count() == 10 and some.rdd.getNumPartitions() <= 2
    assert read().filter("b = 'nothing'").rdd.getNumPartitions() <= 1 and read().filter("a IS NULL").count() == 1
    assert read().filter("a IN (3, 990)").count() == 2
    assert [f.name for f in spark.read.format("ledger").schema("b string").option("path", path).load().schema.fields] == ["b"]


def test_ledger_after_a_kill(spark):
    """A batch whose files were written but not committed, and one committed that Spark doesn't know of, run again: nothing is
    lost, nothing comes twice."""
    ledger.register(spark)
    source, target, state = (shared.new_path(spark, n) for n in ("from", "to", "state"))

    def put(low, high):
        spark.range(low, high).select(F.col("id").alias("a")).write.format("ledger").mode("append").option("path", source).save()

    def copy():
        flow = spark.readStream.format("ledger").schema("a long").option("path", source).load()
        flow.writeStream.format("ledger").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    rows = lambda: sorted(r.a for r in spark.read.format("ledger").schema("a long").option("path", target).load().collect())
    put(0, 50)
    copy()
    put(50, 90)
    copy()
    assert rows() == [*range(90)]
    folder, log = target.removeprefix("file://"), state.removeprefix("file://")

    def forget():
        last = max(glob.glob(f"{log}/commits/[0-9]*"))
        os.remove(last)
        os.remove(f"{log}/commits/.{os.path.basename(last)}.crc")

    forget()  # killed after the commit
    copy()
    assert rows() == [*range(90)]
    forget()
    os.remove(max(glob.glob(f"{folder}/manifest-*")))  # killed before it: the files are there, no manifest names them
    assert len(rows()) < 90
    copy()
    assert rows() == [*range(90)]
    named = [f["name"] for m in glob.glob(f"{folder}/manifest-*") for f in json.load(open(m))]
    assert len(named) == len(set(named)) < len(glob.glob(f"{folder}/rows-*"))


@pytest.mark.parametrize("files", [1, 3])
def test_timed_sessions_forget(spark, files):
    """Sessions over several batches, out of order within lateness; what is over leaves the state."""
    start = datetime.datetime(2024, 1, 1)
    hours = {1: [0, 0.5, 1.2, 9, 9.4, 30], 2: [0.1, 5, 20, 20.9, 40], 3: [40.5]}
    rows = sorted((h, u) for u, hs in hours.items() for h in hs)
    events = spark.createDataFrame([(i, start + datetime.timedelta(hours=h), u, "x", 1.0, None) for i, (h, u) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    stream = streams.events(spark, streams.in_files(events, "ts", files))
    seen = []

    def keep(batch, _):
        seen.extend((r.k, (r.begin.replace(tzinfo=None) - start).total_seconds() / 3600, r.n) for r in batch.collect())

    query = timed.closed_sessions(stream, "user_id", "ts", 3600).writeStream.foreachBatch(keep).option("checkpointLocation", shared.new_path(spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(seen) == [(1, 0.0, 3), (1, 9.0, 2), (1, 30.0, 1), (2, 0.1, 1), (2, 5.0, 1), (2, 20.0, 2)]
    states = [op.numRowsTotal for p in query.recentProgress for op in p.stateOperators]
    assert states and states[-1] <= 12  # two keys with an open session each, their lists and timers


def test_timed_sessions_of_many_keys(spark):
    """State and timers grow with buckets, not with keys; any key comes back, and a session whose time is up at the watermark is over."""
    start = datetime.datetime(2024, 1, 1)
    at = lambda **d: start + datetime.timedelta(**d)
    keys = [*range(2000), None, 2**60 + 1]
    rows = [(at(milliseconds=i), u) for i, u in enumerate(keys)] + [(at(hours=8) - datetime.timedelta(milliseconds=1), 6000), (at(hours=8), 6001), (at(hours=10), 5000), (None, 5001)]
    events = spark.createDataFrame([(i, t, u, "x", 1.0, None) for i, (t, u) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    seen = []
    query = timed.closed_sessions(streams.events(spark, streams.in_files(events, "ts", 1)), "user_id", "ts", 3600).writeStream.foreachBatch(lambda batch, _: seen.extend((r.k, r.begin.replace(tzinfo=None), r.n) for r in batch.collect()))
    query = query.option("checkpointLocation", shared.new_path(spark, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(seen) == len(keys) + 1 and set(seen) == {(u, t, 1) for t, u in rows[:-3]}
    assert max(op.numRowsTotal for p in query.recentProgress for op in p.stateOperators) <= 3 * 256


def test_closure_walks_an_edge_once_for_many_sources(spark):
    """Seventy sources, one hub, a thousand targets: a round has two blocks of rows for each target, not a row for each pair."""
    edges = spark.range(70).select((-1 - F.col("id")).alias("a"), F.lit(0).cast("long").alias("b")).unionByName(spark.range(1, 1001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")))
    got = closure.closure(edges, "a", "b", edges.filter("a < 0").select("a"))
    assert got.filter("depth = 2").count() == 70_000 and got.distinct().count() == 70_070 == got.count()
    last = max(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/closure-*"), key=os.path.getmtime)
    assert spark.read.parquet(f"{last}/round-2").count() == 2000
