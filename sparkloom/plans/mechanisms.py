"""Queries on mechanisms of their own: kept sketches, samples, closures, buckets, aggregates in two phases, a ledger of
files, sessions with timers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import two_phase
from sparkloom.operators import closure, sampling, sketches
from sparkloom.sources import ledger, shared
from sparkloom.sources.tables import bucketed, table
from sparkloom.streaming import streams, timed


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sketches.daily(table(spark, sf_dir, "clicks"), ["kind"], "ts", "client_id", "value")
    path = shared.new_path(spark, "sketches")
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def sketch_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients of each kind and month from the days' sketches, beside the exact number, and whether it lies in each bound."""
    kept = _kept(spark, sf_dir).withColumn("month", F.month("day"))
    got = sketches.merged(kept, ["kind", "month"]).select(
        F.col("kind").alias("k"), F.col("month").alias("m"), "n", F.theta_sketch_estimate("theta").alias("theta"), F.hll_sketch_estimate("hll").alias("hll"),
    )
    exact = table(spark, sf_dir, "clicks").groupBy("kind", F.month("ts").alias("month")).agg(F.count_distinct("client_id").alias("clients"))
    both = exact.join(got, F.col("k").eqNullSafe(F.col("kind")) & F.col("m").eqNullSafe(F.col("month")))
    within = lambda c, b: F.abs(F.col(c) - F.col("clients")) <= F.ceil(F.col("clients") * b)
    return both.select("kind", "month", "n", "clients", within("theta", sketches.THETA_BOUND).alias("theta_ok"), within("hll", sketches.HLL_BOUND).alias("hll_ok"))


def sketch_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of each kind over all days: distinct clients two ways, those in common with views, quartiles of the value."""
    whole = sketches.merged(_kept(spark, sf_dir), ["kind"])
    views = whole.filter("kind = 'view'").select(F.col("theta").alias("views"))
    quartiles = [F.kll_sketch_get_quantile_double("kll", F.lit(q)).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return whole.crossJoin(F.broadcast(views)).select("kind", "n", F.hll_sketch_estimate("hll").alias("hll"), F.theta_sketch_estimate("theta").alias("theta"), sketches.in_both("theta", "views").alias("with_views"), *quartiles)


def sample_per_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty sale lines of each vendor, chances by amount."""
    l = table(spark, sf_dir, "sale_lines").select("vendor_id", "sale_id", "line_no", "item_id", "quantity", "amount").distinct()
    return sampling.weighted(l, ["vendor_id"], ["sale_id", "line_no", "item_id", "quantity", "amount"], "amount", 20)


def closure_of_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clients that stand above each one, and how far."""
    return closure.closure(table(spark, sf_dir, "clients").filter("client_id <> master_id"), "client_id", "master_id")


def closure_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts that supply leads to from each nation's first supplier: a graph with cycles."""
    lines = table(spark, sf_dir, "lineitem").select((-1 - F.col("l_suppkey")).alias("a"), F.col("l_partkey").alias("b"))
    edges = lines.unionByName(lines.select(F.col("b").alias("a"), F.col("a").alias("b")))
    starts = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s")).select((-1 - F.col("s")).alias("a"))
    return closure.closure(edges, "a", "b", starts)


def bucketed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of each sale from two tables with one layout."""
    mark = uuid.uuid4().hex[:8]
    s, l = table(spark, sf_dir, "sales").select("sale_id", "status"), table(spark, sf_dir, "sale_lines").select("sale_id", F.col("amount").cast("decimal(18,2)").alias("amount"))
    s, l = (bucketed(df, f"{name}_{mark}", shared.new_path(spark, name), 16, ["sale_id"]) for df, name in ((s, "sales"), (l, "lines")))
    return s.join(l, "sale_id").groupBy("sale_id", "status").agg(F.sum("amount").alias("amount"), F.count("*").alias("lines"))


def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amount on quantity and discount, by flag."""
    l = table(spark, sf_dir, "sale_lines").select("flag", "amount", "quantity", "discount")
    got = two_phase.aggregate(l, ["flag"], ["amount", "quantity", "discount"], two_phase.LeastSquares(), "c")
    return got.select("flag", *(F.round(F.col("c")[k], 4).alias(f"c{k}") for k in range(3)))


_ROW = "click_id long, client_id long, kind string"


def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks through a Python source and sink: written in three commits, copied by a stream in two goes, read back."""
    ledger.register(spark)
    source, target, state = (shared.new_path(spark, n) for n in ("ledger", "copied", "state"))
    c = table(spark, sf_dir, "clicks").select("click_id", "client_id", "kind")

    def put(part: int) -> None:
        c.filter(F.pmod(F.coalesce("click_id", F.lit(0)), F.lit(3)) == part).write.format("ledger").mode("append").option("path", source).save()

    def copy() -> None:
        flow = spark.readStream.format("ledger").schema(_ROW).option("path", source).load()
        flow.writeStream.format("ledger").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    put(0)
    put(1)
    copy()
    put(2)
    copy()
    return spark.read.format("ledger").schema(_ROW).option("path", target).load()


def ledger_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One client's clicks from a ledger in client order, most of whose files the filter leaves out."""
    ledger.register(spark)
    path = shared.new_path(spark, "ledger")
    c = table(spark, sf_dir, "clicks").select("click_id", "client_id", "kind").repartitionByRange(16, "client_id", "click_id")
    c.write.format("ledger").mode("append").option("path", path).save()
    return spark.read.format("ledger").schema(_ROW).option("path", path).load().filter("client_id >= 40 AND client_id < 60")


def stream_timed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are surely over: state of its own with timers."""
    events = streams.events(spark, streams.in_files(table(spark, sf_dir, "events"), "ts", 4))
    got = streams.finished(timed.closed_sessions(events, "user_id", "ts", 3600))
    return got.select(F.col("k").alias("user_id"), F.col("begin").cast("timestamp_ntz").alias("win_start"), "n")


MECHANISMS: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    sketch_months, sketch_estimates, sample_per_vendor, closure_of_masters, closure_of_parts, bucketed_sales, least_squares, ledger_stream, ledger_pruned, stream_timed_sessions,
)

_SUMS = ", ".join(f"sum({a} * {b}) AS {a}{b}" for a, b in (("x", "x"), ("x", "y"), ("y", "y"), ("x", "z"), ("y", "z")))

ORACLE = {
    "sketch_months": "SELECT kind, CAST(month(ts) AS INT) AS month, count(*) AS n, count(DISTINCT client_id) AS clients, true AS theta_ok, true AS hll_ok FROM clicks GROUP BY ALL",
    "sample_per_vendor": """SELECT vendor_id, sale_id, line_no, item_id, quantity, amount FROM (SELECT *, -ln((CAST('0x' || substr(md5('7:' || concat_ws(':', coalesce(CAST(sale_id AS VARCHAR), '~'), CAST(line_no AS VARCHAR),
        coalesce(CAST(item_id AS VARCHAR), '~'), coalesce(CAST(quantity AS VARCHAR), '~'), CAST(amount AS VARCHAR))), 1, 13) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE) / amount AS t
        FROM (SELECT DISTINCT vendor_id, sale_id, line_no, item_id, quantity, amount FROM sale_lines WHERE amount > 0)) QUALIFY row_number() OVER (PARTITION BY vendor_id ORDER BY t) <= 20""",
    "closure_of_masters": """WITH RECURSIVE e AS (SELECT DISTINCT client_id AS s, master_id AS t FROM clients WHERE client_id <> master_id),
        c AS (SELECT s, t, 1 AS depth FROM e UNION SELECT c.s, e.t, c.depth + 1 FROM c JOIN e ON c.t = e.s WHERE c.depth < 60)
        SELECT s AS client_id, t AS master_id, min(depth) AS depth FROM c GROUP BY ALL""",
    "closure_of_parts": """WITH RECURSIVE l AS (SELECT DISTINCT -1 - l_suppkey AS a, l_partkey AS b FROM lineitem), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        c AS (SELECT -1 - min(s_suppkey) AS a, -1 - min(s_suppkey) AS b, 0 AS depth FROM supplier GROUP BY s_nationkey UNION SELECT c.a, e.b, c.depth + 1 FROM c JOIN e ON e.a = c.b WHERE c.depth < 8)
        SELECT a, b, min(depth) AS depth FROM c WHERE depth > 0 GROUP BY a, b""",
    "bucketed_sales": "SELECT s.sale_id, status, sum(CAST(amount AS DECIMAL(18,2))) AS amount, count(*) AS lines FROM sales s JOIN sale_lines l ON s.sale_id = l.sale_id GROUP BY ALL",
    "least_squares": f"""SELECT flag, round(mz - b * mx - c * my, 4) AS c0, round(b, 4) AS c1, round(c, 4) AS c2 FROM (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS b, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS c
        FROM (SELECT flag, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, {_SUMS} FROM (SELECT flag, mx, my, mz, quantity - mx AS x, discount - my AS y, amount - mz AS z
        FROM (SELECT *, avg(quantity) OVER w AS mx, avg(discount) OVER w AS my, avg(amount) OVER w AS mz FROM sale_lines WHERE quantity IS NOT NULL AND discount IS NOT NULL AND amount IS NOT NULL
        WINDOW w AS (PARTITION BY flag))) GROUP BY flag))""",
    "ledger_stream": "SELECT click_id, client_id, kind FROM clicks",
    "ledger_pruned": "SELECT click_id, client_id, kind FROM clicks WHERE client_id >= 40 AND client_id < 60",
    "stream_timed_sessions": """SELECT user_id, win_start, n FROM (SELECT user_id, min(ts) AS win_start, max(ts) AS stop, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s
        FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '1 hour' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s)
        WHERE date_trunc('millisecond', stop) + INTERVAL '1 hour 1 millisecond' <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL '1 hour'""",
}
