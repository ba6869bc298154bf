"""General queries with their DuckDB SQL. Text that both engines read alike is shared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scalars
from sparkloom.operators import relational
from sparkloom.plans.frames import FRAMES, ORACLE
from sparkloom.plans.mechanisms import MECHANISMS
from sparkloom.plans.mechanisms import ORACLE as MECHANISM_SQL
from sparkloom.plans.ordered import ORACLE as ORDER_SQL
from sparkloom.plans.ordered import ORDERED
from sparkloom.plans.sql_texts import TEXTS
from sparkloom.sources.tables import register, table
from sparkloom.streaming import windows

#: SQL that Spark and DuckDB both run as it stands: name -> (tables, text).
SHARED: dict[str, tuple[list[str], str]] = {
    "scan_filter_project": (["lineitem"], "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'"),
    "pricing_summary": (["lineitem"], """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DECIMAL(25,2)) AS sum_qty,
        CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_supp, max(l_extendedprice) AS max_price
        FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""),
    "join_left": (["orders", "lineitem"], "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'"),
    "join_full": (["nation", "supplier"], "SELECT n_name, s_suppkey FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0"),
    "join_anti": (["orders", "lineitem"], "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "join_semi": (["customer", "orders"], "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)"),
    "grouping_sets": (["orders"], """SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders
        GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"""),
    "rollup": (["customer"], "SELECT c_mktsegment, c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)"),
    "cube": (["part"], "SELECT p_brand, p_size, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY CUBE (p_brand, p_size)"),
    "having": (["orders"], "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12"),
    "window_rank": (["customer"], """SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS BIGINT) AS r,
        CAST(dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS BIGINT) AS dr FROM customer"""),
    "window_lag_lead": (["events"], """SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS prev_id,
        lead(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS next_id FROM events"""),
    "window_running": (["orders"], """SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM orders"""),
    "union_all": (["nation"], "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation"),
    "union_distinct": (["customer", "supplier"], "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "intersect": (["customer", "supplier"], "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "except": (["part", "lineitem"], "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45"),
    "sort_limit": (["orders"], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "case_coalesce": (["orders"], """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size,
        coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status FROM orders"""),
    "strings": (["customer"], """SELECT c_custkey, upper(c_mktsegment) AS u, substring(c_name, 1, 8) AS s, replace(c_name, '#', '-') AS r,
        trim(c_name) AS t, CAST(length(c_name) AS BIGINT) AS n FROM customer"""),
    "scalar_subquery": (["part"], "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.02 FROM part)"),
    "recursive_cte": (["clients"], """WITH RECURSIVE up(client_id, above, depth) AS (SELECT client_id, master_id, 1 FROM clients WHERE client_id <> master_id
        UNION ALL SELECT u.client_id, c.master_id, u.depth + 1 FROM up u JOIN clients c ON u.above = c.client_id WHERE c.client_id <> c.master_id AND u.depth < 20)
        SELECT client_id, above, depth FROM up"""),
}


def _sql(tables: list[str], text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, tables)
        return spark.sql(text)

    return run


def revenue_by_nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line revenue by customer nation and order month; the small dimension tables are broadcast by size."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", scalars.revenue().alias("r"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", scalars.month("o_orderdate").alias("order_month"))
    who = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    j = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("n_name", "order_month").agg(F.sum("r").cast("decimal(38,4)").alias("revenue"))


def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return relational.top_k(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2)


def exclude_current_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return relational.sum_of_others(o, ["o_custkey"], "o_orderkey", "others").select("o_orderkey", "others")


def groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return relational.groups_frame_sum(o, ["o_custkey"], "o_orderdate", "o_orderkey", 1, "s").select("o_orderkey", "s")


def salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return relational.salted_join(e.select("event_id", "event_type"), e.groupBy("event_type").agg(F.count("*").alias("n")), "event_type", 20_000).select("event_id", "n")


def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count("l_orderkey"))
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("n_f"), F.coalesce("O", F.lit(0)).alias("n_o"))


def unpivot_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "name", "val")


def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def array_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(scalars.dot("embedding", "embedding"), 4).alias("norm2"))


def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(table(spark, sf_dir, "events"), "1 hour")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(table(spark, sf_dir, "events"), "1 hour")


_FRAMES = (
    revenue_by_nation_month, top_orders_per_customer, exclude_current_row, groups_frame,
    salted_join, pivot_counts, unpivot_balances, json_field, array_dot, tumbling_window, session_windows,
)

_ORACLE = {
    "revenue_by_nation_month": """SELECT n_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS order_month,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (CAST(1 AS DECIMAL(3,2)) - CAST(l_discount AS DECIMAL(3,2)))) AS DECIMAL(38,4)) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""",
    "top_orders_per_customer": """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2""",
    "exclude_current_row": """SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING
        AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS others FROM orders""",
    "groups_frame": """SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate
        GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders""",
    "salted_join": "SELECT event_id, n FROM events JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) USING (event_type)",
    "pivot_counts": """SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS n_f, count(*) FILTER (l_linestatus = 'O') AS n_o
        FROM lineitem GROUP BY l_returnflag""",
    "unpivot_balances": """SELECT p_partkey, 'size' AS name, CAST(p_size AS DOUBLE) AS val FROM part
        UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part""",
    "json_field": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "array_dot": """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm2 FROM embeddings""",
    "tumbling_window": """SELECT time_bucket(INTERVAL '1 hour', ts) AS win_start, event_type, count(*) AS n,
        CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS total FROM events GROUP BY ALL""",
    "session_windows": """SELECT user_id, min(ts) AS win_start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s
        FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '1 hour' THEN 0 ELSE 1 END AS fresh FROM events))
        GROUP BY user_id, s""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    texts = {name: _sql(*q) for name, q in SHARED.items()} | {name: _sql(tables, text) for name, (tables, text, _) in TEXTS.items()}
    return texts | {f.__name__: f for f in (*_FRAMES, *FRAMES, *ORDERED, *MECHANISMS)}


def oracle_sql() -> dict[str, str]:
    shared = {name: text.replace("TIMESTAMP_NTZ", "TIMESTAMP") for name, (_, text) in SHARED.items()} | {name: other or text for name, (_, text, other) in TEXTS.items()}
    streams = {"stream_tumbling": _ORACLE["tumbling_window"], "stream_sessions": _ORACLE["session_windows"], "stream_sliding": shared["sliding_window"]}
    return shared | _ORACLE | ORACLE | ORDER_SQL | MECHANISM_SQL | streams
