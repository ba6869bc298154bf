"""Plans, streams with late rows, sources and the driver's entry, beyond the queries that DuckDB checks."""

import datetime
import importlib
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import python_functions as py
from sparkloom.operators import relational
from sparkloom.sources import shared
from sparkloom.sources.tables import read, table, write
from sparkloom.streaming import streams, windows

SF = "/root/testdata/sf0.01"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("hint", "node"), [("BROADCAST(r)", "BroadcastHashJoin"), ("MERGE(r)", "SortMergeJoin"), ("SHUFFLE_HASH(r)", "ShuffledHashJoin"), ("SHUFFLE_REPLICATE_NL(r)", "CartesianProduct")]
)
def test_join_strategies(spark, hint, node):
    table(spark, SF, "orders").createOrReplaceTempView("o")
    table(spark, SF, "customer").createOrReplaceTempView("r")
    df = spark.sql(f"SELECT /*+ {hint} */ o_orderkey, c_name FROM o JOIN r ON o_custkey = c_custkey WHERE o_orderkey < 300")
    assert node in plan_of(df) and df.count() == table(spark, SF, "orders").filter("o_orderkey < 300").count()


def test_aggregate_and_limit_plans(spark):
    o = table(spark, SF, "orders")
    assert "TakeOrderedAndProject" in plan_of(o.orderBy("o_totalprice").limit(5))
    assert "WindowGroupLimit" in plan_of(relational.top_k(o, ["o_custkey"], [F.col("o_totalprice").desc()], 2))
    assert "BroadcastNestedLoopJoin" in plan_of(o.hint("broadcast").join(table(spark, SF, "nation"), F.col("o_totalprice") < F.col("n_nationkey")))
    assert "ObjectHashAggregate" in plan_of(o.groupBy("o_custkey").agg(F.collect_set("o_orderstatus")))


def test_scan_is_pruned(spark):
    text = table(spark, SF, "lineitem").filter("l_quantity > 49").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    path = shared.new_path(spark, "pruned")
    write(table(spark, SF, "orders").select("o_orderkey", "o_orderstatus"), path, "parquet", ["o_orderstatus"])
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan_of(read(spark, path, "parquet").filter("o_orderstatus = 'F'"))


def _event(i, hour, user=1, kind="view"):
    return (i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour), user, kind, 1.0, None)


SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _feed(spark, path, *batches):
    """One file for each batch, in order of time of change."""
    import time

    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def _windows(rows):
    return {r.win_start.hour + 24 * (r.win_start.day - 1): r.n for r in rows}


def test_stream_drops_late_rows(spark):
    """Windows come out once the watermark has passed; rows behind the watermark of the batch before are dropped, nearer ones count."""
    path = shared.new_path(spark, "late")
    _feed(spark, path, [_event(1, 1), _event(2, 2), _event(3, 10)], [_event(4, 12), _event(5, 9.5)], [_event(6, 1.5), _event(7, 11.2), _event(8, 20)], [_event(9, 30)])
    got = streams.finished(windows.tumbling(streams.events(spark, path), "1 hour"))
    assert _windows(got.collect()) == {1: 1, 2: 1, 9: 1, 10: 1, 11: 1, 12: 1, 20: 1}  # 6 came after its window; 30 is still open


def test_stream_goes_on_from_its_checkpoint(spark):
    path, state, out = (shared.new_path(spark, n) for n in ("more", "state", "out"))
    _feed(spark, path, [_event(1, 1, 5), _event(2, 2, 6)])
    first = streams.finished(streams.running_totals(streams.events(spark, path), "user_id"), "update", state, out)
    assert {(r.k, r.n) for r in first.collect()} == {(5, 1), (6, 1)}
    _feed(spark, path, [_event(3, 3, 5)])
    again = streams.finished(streams.running_totals(streams.events(spark, path), "user_id"), "update", state, out)
    assert {(r.k, r.n, r.last_event) for r in again.collect()} == {(5, 1, 1), (6, 1, 2), (5, 2, 3)}


def test_stream_state_goes_when_idle(spark):
    """A key unseen for longer than ``idle`` behind the watermark leaves the state, and starts from one when it comes again."""
    path = shared.new_path(spark, "idle")
    _feed(spark, path, [_event(1, 0, 5), _event(2, 0.1, 5), _event(3, 0.2, 6)], [_event(4, 10, 6)], [_event(5, 20, 6), _event(6, 20.1, 5)], [_event(7, 40, 6)])
    got = streams.finished(streams.running_totals(streams.events(spark, path), "user_id", 30 * 60_000), "update").collect()
    assert (5, 2, 2) in {tuple(r) for r in got} and (5, 1, 6) in {tuple(r) for r in got} and (5, 3, 6) not in {tuple(r) for r in got}


def test_stream_sliding_dedup_and_join(spark):
    path = shared.new_path(spark, "several")
    _feed(spark, path, [_event(1, 1, 1, "click"), _event(1, 1, 1, "click"), _event(2, 1.5, 2)], [_event(1, 1.2, 1, "click"), _event(3, 1.9, 1, "purchase"), _event(4, 9, 1, "purchase")])
    e = streams.events(spark, path)
    assert sorted(r.event_id for r in streams.finished(streams.first_of(e, ["event_id"])).collect()) == [1, 2, 3, 4]
    assert _windows(streams.finished(streams.sliding(e, "2 hours", "1 hour"), "complete").collect()) == {0: 5, 1: 5, 8: 1, 9: 1}
    clicks, bought = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("a")), e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("b"), "event_id")
    assert [r.event_id for r in streams.finished(streams.within(clicks, bought, "user_id", "a", "b", "2 HOURS").select("event_id")).collect()] == [3, 3, 3]
    seen = []
    streams.each_batch(e, lambda b: seen.append(b.count()), shared.new_path(spark, "each"))
    assert seen == [3, 3]


def test_stream_distinct_over_batches(spark):
    """Keys that come again long after the watermark: first_of forgets them, first_ever doesn't."""
    path = shared.new_path(spark, "again")
    _feed(spark, path, *([_event(4 * b + i, 100 * b + i, i) for i in range(4)] for b in range(4)))
    e = streams.events(spark, path)
    assert sorted(r.user_id for r in streams.finished(streams.first_ever(e, ["user_id"])).collect()) == [0, 1, 2, 3]
    assert streams.finished(streams.first_of(e, ["user_id"])).count() > 4


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 5, 1, 2), (1, 4, 3, 4), (2, 9, 5, 6)], "k int, v int, rank int, group int")
    assert sorted(tuple(r) for r in relational.top_k(df, ["k"], [F.col("v").desc()], 1).collect()) == [(1, 5, 1, 2), (2, 9, 5, 6)]
    assert sorted(tuple(r) for r in relational.groups_frame_sum(df, ["k"], "v", "v", 1, "s").collect()) == [(1, 4, 3, 4, 4), (1, 5, 1, 2, 9), (2, 9, 5, 6, 9)]
    many = spark.createDataFrame([(1, 7, 8)] * 50 + [(2, 7, 8), (None, 7, 8)], "k int, salt int, salts int")
    got = relational.salted_join(many, spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "k int, name string"), "k", 10)
    assert got.columns == ["k", "salt", "salts", "name"] and got.groupBy("name").count().collect() and {tuple(r) for r in got.groupBy("name").count().collect()} == {("a", 50), ("b", 1)}


def test_python_functions_with_nulls(spark):
    df = spark.createDataFrame([("Ångström", "angstrom"), (None, "x"), ("", ""), ("abc", None), ("martha", "marhta")], "a string, b string")
    got = df.select(py.without_accents("a").alias("p"), F.round(py.edit_share("a", "b"), 4).alias("s")).collect()
    assert [r.p for r in got] == ["Angstrom", None, "", "abc", "martha"] and [r.s for r in got[1:]] == [None, 1.0, None, 0.9444]


def test_shared_folder_is_asked_for():
    class Context:
        master = "spark://x"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        shared.new_path(Session, "x")


def test_entry_without_the_optional_parts():
    """A missing library or folder takes only the optional queries with it."""
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; n = e.queries(); assert len(n) > 50 and not any(k.startswith('op') for k in n) and set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=importlib.import_module("pathlib").Path(__file__).parents[1])
