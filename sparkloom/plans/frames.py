"""Queries on the DataFrame API: streams run to their end, files written and read again, functions in Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import python_functions as py
from sparkloom.operators import sampling
from sparkloom.sources import python_source, shared
from sparkloom.sources.tables import read, table, write
from sparkloom.streaming import streams, windows


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of four files in order of time, a batch each, so that state passes from batch to batch."""
    return streams.events(spark, streams.in_files(table(spark, sf_dir, "events"), "ts", 4))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = streams.finished(windows.tumbling(_events(spark, sf_dir), "1 hour"), "complete")
    return got.withColumn("win_start", F.col("win_start").cast("timestamp_ntz"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = streams.finished(streams.sliding(_events(spark, sf_dir), "2 hours", "1 hour"), "complete")
    return got.withColumn("win_start", F.col("win_start").cast("timestamp_ntz"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = streams.finished(windows.sessions(_events(spark, sf_dir), "1 hour"), "complete")
    return got.withColumn("win_start", F.col("win_start").cast("timestamp_ntz"))


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.finished(streams.first_ever(_events(spark, sf_dir), ["user_id", "event_type"])).select("user_id", "event_type")


def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    bought = _events(spark, sf_dir).filter("event_type = 'purchase'").join(who, "user_id").select("event_id", "c_mktsegment")
    return streams.finished(bought)


def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("clicked"), F.col("event_id").alias("click"))
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("purchase"))
    return streams.finished(streams.within(clicks, bought, "user_id", "clicked", "bought", "2 HOURS").select("click", "purchase"))


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = streams.finished(streams.running_totals(_events(spark, sf_dir), "user_id"), "update")
    return got.groupBy("k").agg(F.max("n").alias("n"), F.max("last_event").alias("last_event"))


def _again(spark: SparkSession, df: DataFrame, fmt: str, partition_by: list[str] | None = None, **options) -> DataFrame:
    path = shared.new_path(spark, fmt)
    write(df, path, fmt, partition_by, **options)
    return read(spark, path, fmt, df.schema, **options)


def files_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, table(spark, sf_dir, "orders"), "orc").filter("o_totalprice > 200000").select("o_orderkey", "o_orderdate")


def files_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, table(spark, sf_dir, "events").select("event_id", "props", "value"), "json")


def files_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, table(spark, sf_dir, "customer"), "csv", header="true")


def files_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, table(spark, sf_dir, "nation"), "xml", rowTag="row")


def files_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, table(spark, sf_dir, "region").select(F.col("r_name").alias("value")), "text")


def files_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return _again(spark, lines, "parquet", ["l_returnflag"]).filter("l_returnflag = 'A' AND l_quantity > 40").select("l_orderkey", "l_linenumber")


def files_python_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    python_source.register(spark)
    path = shared.new_path(spark, "keyvalue")
    table(spark, sf_dir, "nation").select(F.concat_ws(" ", F.concat(F.lit("id="), "n_nationkey"), F.concat(F.lit("region="), "n_regionkey"))).write.text(path)
    rows = spark.read.format("keyvalue").schema("id string, region string").option("path", path).load()
    return rows.select(F.col("id").cast("int").alias("id"), F.col("region").cast("int").alias("region"))


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey"), allowMissingColumns=True)


def sample_is_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders, by a hash of the key: the same rows at every run, in any engine."""
    return table(spark, sf_dir, "orders").select("o_orderkey").filter(sampling.share_of_one(F.col("o_orderkey"), 7) <= 0.1)


def fill_and_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("status"), F.expr("nullif(o_custkey, 5)").alias("cust"))
    return o.na.fill({"status": "none"}).na.replace("F", "done", "status").na.drop(subset=["cust"])


def pandas_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clients").select("client_id", "updated_at", py.without_accents("name").alias("plain"))


def pandas_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near a client's name is to the mailbox it signs with."""
    c = table(spark, sf_dir, "clients").select("client_id", "updated_at", F.lower("name").alias("name"), F.substring_index("email", "@", 1).alias("box"))
    return c.select("client_id", "updated_at", F.round(py.edit_share(py.without_accents("name"), py.without_accents("box")), 9).alias("near"))


def arrow_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return py.resampled(table(spark, sf_dir, "clicks"), 900, "ts", "value", "click_id")


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("words_of", py.Words)
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, word, at FROM part, LATERAL words_of(concat(p_brand, ' of  ', p_type))")


def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION net_of(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN round(price * (1 - discount), 4)")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber, net_of(l_extendedprice, l_discount) AS net FROM lineitem")


FRAMES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    stream_tumbling, stream_sliding, stream_sessions, stream_distinct, stream_static_join, stream_stream_join, stream_state, files_orc, files_json, files_csv, files_xml, files_text,
    files_partitioned, files_python_source, union_by_name, sample_is_stable, fill_and_replace, pandas_scalar, pandas_two_columns, arrow_batches,
    table_function, sql_function,
)

ORACLE = {
    "stream_distinct": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_static_join": "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'",
    "stream_stream_join": """SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase'
        AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL '2 hours'""",
    "stream_state": "SELECT user_id AS k, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY user_id",
    "files_orc": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_totalprice > 200000",
    "files_json": "SELECT event_id, props, value FROM events",
    "files_csv": "SELECT * FROM customer",
    "files_xml": "SELECT * FROM nation",
    "files_text": "SELECT r_name AS value FROM region",
    "files_partitioned": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40",
    "files_python_source": "SELECT n_nationkey AS id, n_regionkey AS region FROM nation",
    "union_by_name": "SELECT c_custkey, c_nationkey AS nation, NULL::BIGINT AS s_suppkey FROM customer UNION ALL BY NAME SELECT s_nationkey AS nation, s_suppkey FROM supplier",
    "sample_is_stable": "SELECT o_orderkey FROM orders WHERE (CAST('0x' || substr(md5('7:' || o_orderkey), 1, 13) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE <= 0.1::DOUBLE",
    "fill_and_replace": """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'none' WHEN 'F' THEN 'done' ELSE o_orderstatus END AS status, o_custkey AS cust FROM orders WHERE o_custkey <> 5""",
    "pandas_scalar": "SELECT client_id, updated_at, strip_accents(name) AS plain FROM clients",
    "pandas_two_columns": "SELECT client_id, updated_at, round(jaro_similarity(strip_accents(lower(name)), strip_accents(split_part(email, '@', 1))), 9) AS near FROM clients",
    "arrow_batches": """SELECT click_id, CAST(epoch_us(ts) // 900000000 AS BIGINT) AS step, CASE WHEN value = 0 THEN 0 ELSE value / pow(2, e) END AS fraction, CASE WHEN value = 0 THEN 0 ELSE e END AS exponent
        FROM (SELECT click_id, ts, value, CAST(floor(log2(nullif(abs(value), 0))) AS INT) + 1 AS e FROM clicks)""",
    "table_function": "SELECT p_partkey, words[i] AS word, CAST(i - 1 AS INT) AS at FROM (SELECT p_partkey, words, unnest(range(1, len(words) + 1)) AS i FROM (SELECT p_partkey, [p_brand, 'of', p_type] AS words FROM part))",
    "sql_function": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem",
}
