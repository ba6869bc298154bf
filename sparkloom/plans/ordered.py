"""Queries on order: scans, as-of joins, intervals and sliding frames over tables with hot keys, nulls and repeated rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import intervals, scan, sliding
from sparkloom.sources.tables import table

_MONEY = "decimal(18,2)"


def _clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clicks").select("click_id", "client_id", "ts", "kind", "value")


def scan_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running quantity and rank over the whole table, without a key."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.col("l_quantity").cast(_MONEY).alias("q"))
    out = {"so_far": ("sum", "q"), "nth": ("rank",), "day": ("dense_rank",)}
    return scan.prefix_scan(l, ["l_shipdate"], out, None, ["l_orderkey", "l_linenumber", "q"])


def scan_clicks_of_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running values per client, one of whom has much of the table."""
    c = _clicks(spark, sf_dir).withColumn("value", F.col("value").cast(_MONEY))
    out = {"so_far": ("sum", "value"), "valued": ("count", "value"), "least": ("min", "value"), "most": ("max", "value"), "last_kind": ("last", "kind"), "before": ("lag", "kind"), "nth": ("row_number",), "rank": ("rank",), "dense": ("dense_rank",)}
    return scan.prefix_scan(c, ["ts"], out, ["client_id"], ["click_id", "value", "kind"])


def asof_last_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The client's last sale at each click, if it is at most three days old."""
    s = table(spark, sf_dir, "sales").select("client_id", "sold_at", F.col("sale_id").alias("sale"), F.col("total").alias("sale_total"))
    return scan.asof_join(_clicks(spark, sf_dir).drop("kind", "value"), s, ["client_id"], "ts", "sold_at", ["sale", "sale_total"], F.expr("INTERVAL 3 DAYS"))


def asof_last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    p = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return scan.asof_join(e, p, ["user_id"], "ts", "ts", ["last_purchase"]).select("event_id", "last_purchase")


def range_join_price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 4).alias("lo"), (F.col("n_nationkey") * 4 + 6).alias("hi"))
    return intervals.points_in_intervals(table(spark, sf_dir, "part").select("p_partkey", "p_size"), bands, "p_size", "lo", "hi").select("p_partkey", "n_nationkey")


def range_join_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click values within three quarters above a vendor's balance."""
    v = table(spark, sf_dir, "vendors").select("vendor_id", "balance", (F.col("balance") + 0.75).alias("top"))
    return intervals.points_in_intervals(_clicks(spark, sf_dir).select("click_id", "value"), v, "value", "balance", "top").select("click_id", "vendor_id")


def overlap_sales_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales and clicks of one client that were on their way at the same time."""
    s = table(spark, sf_dir, "sales").select("sale_id", F.col("client_id").alias("buyer"), "sold_at", F.col("arrived_at").alias("sale_in"))
    c = table(spark, sf_dir, "clicks").select("click_id", F.col("client_id").alias("clicker"), "ts", F.col("arrived_at").alias("click_in"))
    return intervals.overlap_join(s, c, "sold_at", "sale_in", "ts", "click_in", [("buyer", "clicker")]).select("sale_id", "click_id")


def overlap_price_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a vendor's and an item's price range (doubles) that overlap."""
    v = table(spark, sf_dir, "vendors").select("vendor_id", F.col("balance").alias("low"), (F.col("balance") * 1.001 + 0.01).alias("high"))
    i = table(spark, sf_dir, "items").select("item_id", F.col("price").alias("from"), (F.col("price") + F.col("size") / 8).alias("to"))
    return intervals.overlap_join(v, i, "low", "high", "from", "to").select("vendor_id", "item_id")


def distinct_in_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands' vendors: distinct vendors among an item's last 20 sale lines."""
    l = table(spark, sf_dir, "sale_lines").select("item_id", "shipped_at", "sale_id", "line_no", "vendor_id", "quantity", "amount")
    return sliding.distinct_in_rows(l, ["item_id"], ["shipped_at", "sale_id", "line_no", "vendor_id", "quantity", "amount"], "vendor_id", 20, "vendors")


def distinct_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct kinds of a client's clicks in the six hours before each."""
    return sliding.distinct_in_range(_clicks(spark, sf_dir), ["client_id"], "ts", "kind", F.expr("INTERVAL 6 HOURS"), "kinds")


def median_in_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.median_in_rows(_clicks(spark, sf_dir), ["client_id"], ["ts", "click_id", "value", "kind"], "value", 50, "middle")


def median_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.median_in_range(_clicks(spark, sf_dir), ["client_id"], "ts", "value", F.expr("INTERVAL 12 HOURS"), "middle")


ORDERED: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    scan_all_lines, scan_clicks_of_client, asof_last_sale, asof_last_order, range_join_price_bands, range_join_fractions, overlap_sales_clicks, overlap_price_ranges, distinct_in_rows,
    distinct_in_range, median_in_rows, median_in_range,
)

_CLICKS = "(SELECT click_id, client_id, ts, kind, value, row_number() OVER (PARTITION BY client_id ORDER BY ts NULLS FIRST, click_id NULLS FIRST, value NULLS FIRST, kind NULLS FIRST) AS i FROM clicks)"

ORACLE = {
    "scan_all_lines": """SELECT l_orderkey, l_linenumber, l_shipdate, CAST(l_quantity AS DECIMAL(18,2)) AS q, rank() OVER (ORDER BY l_shipdate NULLS FIRST) AS nth, dense_rank() OVER (ORDER BY l_shipdate NULLS FIRST) AS day,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (ORDER BY l_shipdate NULLS FIRST, l_orderkey NULLS FIRST, l_linenumber NULLS FIRST, l_quantity NULLS FIRST ROWS UNBOUNDED PRECEDING) AS DECIMAL(28,2)) AS so_far FROM lineitem""",
    "scan_clicks_of_client": """SELECT click_id, client_id, ts, kind, value, CAST(sum(value) OVER w AS DECIMAL(28,2)) AS so_far, count(value) OVER w AS valued, min(value) OVER w AS least, max(value) OVER w AS most,
        last_value(kind IGNORE NULLS) OVER w AS last_kind, lag(kind) OVER w AS before, row_number() OVER w AS nth, rank() OVER p AS rank, dense_rank() OVER p AS dense
        FROM (SELECT * REPLACE (CAST(value AS DECIMAL(18,2)) AS value) FROM clicks) WINDOW p AS (PARTITION BY client_id ORDER BY ts NULLS FIRST),
        w AS (PARTITION BY client_id ORDER BY ts NULLS FIRST, click_id NULLS FIRST, value NULLS FIRST, kind NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "asof_last_sale": """SELECT click_id, c.client_id, ts, CASE WHEN ts - sold_at <= INTERVAL '3 days' THEN sale_id END AS sale, CASE WHEN ts - sold_at <= INTERVAL '3 days' THEN total END AS sale_total
        FROM clicks c ASOF LEFT JOIN (SELECT * FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY client_id, sold_at ORDER BY sale_id DESC NULLS LAST, total DESC NULLS LAST) = 1) s ON c.client_id = s.client_id AND c.ts >= s.sold_at""",
    "asof_last_order": """SELECT e.event_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN
        (SELECT * FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) p ON e.user_id = p.user_id AND e.ts >= p.ts""",
    "range_join_price_bands": "SELECT p_partkey, n_nationkey FROM part JOIN nation ON p_size >= n_nationkey * 4 AND p_size < n_nationkey * 4 + 6",
    "range_join_fractions": "SELECT click_id, vendor_id FROM clicks JOIN vendors ON value >= balance AND value < balance + 0.75::DOUBLE",
    "overlap_sales_clicks": """SELECT sale_id, click_id FROM sales s JOIN clicks c ON s.client_id = c.client_id AND sold_at < c.arrived_at AND ts < s.arrived_at
        WHERE sold_at < s.arrived_at AND ts < c.arrived_at""",
    "overlap_price_ranges": """SELECT vendor_id, item_id FROM vendors JOIN items ON balance < price + size / 8 AND price < balance * 1.001::DOUBLE + 0.01::DOUBLE
        WHERE balance < balance * 1.001::DOUBLE + 0.01::DOUBLE AND price < price + size / 8""",
    "distinct_in_rows": """SELECT item_id, shipped_at, sale_id, line_no, vendor_id, quantity, amount, count(DISTINCT vendor_id) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS vendors
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shipped_at NULLS FIRST, sale_id NULLS FIRST, line_no NULLS FIRST, vendor_id NULLS FIRST, quantity NULLS FIRST, amount NULLS FIRST) AS i FROM sale_lines)""",
    "distinct_in_range": """SELECT click_id, client_id, ts, kind, value, count(DISTINCT kind) OVER (PARTITION BY client_id ORDER BY ts RANGE BETWEEN INTERVAL '6 hours' PRECEDING AND CURRENT ROW) AS kinds FROM clicks""",
    "median_in_rows": f"SELECT click_id, client_id, ts, kind, value, median(value) OVER (PARTITION BY client_id ORDER BY i ROWS BETWEEN 50 PRECEDING AND CURRENT ROW) AS middle FROM {_CLICKS}",
    "median_in_range": """SELECT click_id, client_id, ts, kind, value, CASE WHEN ts IS NOT NULL THEN median(value) OVER (PARTITION BY client_id ORDER BY ts RANGE BETWEEN INTERVAL '12 hours' PRECEDING AND CURRENT ROW) END AS middle
        FROM clicks""",
}
