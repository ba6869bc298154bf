"""SQL queries, each with its DuckDB form: name -> (tables, Spark's text, DuckDB's text or None where both read the same)."""

from __future__ import annotations

TEXTS: dict[str, tuple[list[str], str, str | None]] = {
    # aggregation
    "agg_percentiles": (["orders"], """SELECT o_orderstatus, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 6) AS q1, round(median(o_totalprice), 6) AS mid,
        percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS q9 FROM orders GROUP BY o_orderstatus""", None),
    "agg_max_by_mode": (["lineitem"], """SELECT l_linestatus, max_by(l_orderkey, l_extendedprice * 1000000 + l_orderkey) AS dearest, min_by(l_partkey, l_extendedprice * 1000000 + l_orderkey) AS cheapest,
        mode(l_returnflag) AS flag FROM lineitem GROUP BY l_linestatus""", None),
    "agg_filter": (["lineitem"], """SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS many, CAST(count(*) FILTER (WHERE l_discount = 0) AS BIGINT) AS plain,
        max(l_extendedprice) FILTER (WHERE l_tax > 0.05) AS taxed FROM lineitem GROUP BY l_returnflag""", None),
    "agg_distincts": (["lineitem"], """SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS s, CAST(count(DISTINCT l_partkey) AS BIGINT) AS p,
        CAST(count(DISTINCT l_linenumber, l_linestatus) AS BIGINT) AS both, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag""",
        """SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, count(DISTINCT (l_linenumber, l_linestatus)) AS "both", count(*) AS n FROM lineitem GROUP BY l_returnflag"""),
    "agg_approximate": (["lineitem"], """SELECT l_returnflag, abs(approx_count_distinct(l_orderkey) - count(DISTINCT l_orderkey)) <= 0.15 * count(DISTINCT l_orderkey) AS near FROM lineitem GROUP BY l_returnflag""", None),
    "agg_moments": (["part"], """SELECT p_brand, round(stddev_samp(p_size), 6) AS s, round(var_pop(p_size), 6) AS v, round(corr(p_size, p_retailprice), 6) AS c, round(covar_samp(p_size, p_retailprice), 6) AS cv,
        bool_and(p_size > 0) AS every_one, bool_or(p_size > 49) AS some FROM part GROUP BY p_brand""", None),
    "agg_listagg": (["nation"], "SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey"),
    "agg_grouping": (["customer"], """SELECT c_mktsegment, c_nationkey, CAST(grouping(c_mktsegment) AS BIGINT) AS g1, CAST(grouping(c_nationkey) AS BIGINT) AS g2, CAST(count(*) AS BIGINT) AS n
        FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)""", None),
    "agg_group_by_all": (["orders"], "SELECT o_orderpriority, year(o_orderdate) AS y, CAST(count(*) AS INT) AS n FROM orders GROUP BY ALL",
        "SELECT o_orderpriority, CAST(year(o_orderdate) AS INT) AS y, CAST(count(*) AS INT) AS n FROM orders GROUP BY ALL"),
    "agg_of_nothing": (["part"], "SELECT CAST(count(*) AS BIGINT) AS n, max(p_size) AS m, sum(p_retailprice) AS s FROM part WHERE p_size < 0", None),
    # windows
    "window_row_ntile": (["customer"], """SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quarter
        FROM customer""", """SELECT c_custkey, CAST(row_number() OVER w AS INT) AS rn, CAST(ntile(4) OVER w AS INT) AS quarter FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)"""),
    "window_percent_rank": (["part"], """SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS cd FROM part""", None),
    "window_values": (["events"], """SELECT event_id, first_value(event_id) OVER w AS f, nth_value(event_id, 2) OVER w AS s, last_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS OVER w AS bought
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        """SELECT event_id, first_value(event_id) OVER w AS f, nth_value(event_id, 2) OVER w AS s, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS bought
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "window_range_interval": (["events"], """SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events""", None),
    "window_share": (["part"], """SELECT p_partkey, round(p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand), 9) AS share, round(avg(p_size) OVER (PARTITION BY p_type), 6) AS m FROM part""", None),
    # joins and subqueries
    "join_right": (["orders", "lineitem"], "SELECT l_linenumber, o_orderkey FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey", None),
    "join_cross": (["region", "nation"], "SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_theta": (["supplier", "nation"], "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_suppkey % 25 < n_nationkey AND s_acctbal > n_nationkey * 300", None),
    "join_using_natural": (["supplier", "nation"], "SELECT n_nationkey, s_suppkey FROM nation JOIN (SELECT s_nationkey AS n_nationkey, s_suppkey FROM supplier) s USING (n_nationkey)", None),
    "join_lateral": (["customer", "orders"], """SELECT c_custkey, top FROM customer, LATERAL (SELECT max(o_totalprice) AS top FROM orders WHERE o_custkey = c_custkey) t""", None),
    "join_null_safe": (["nation", "region"], "SELECT a.n_nationkey, b.r_regionkey FROM (SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation) a JOIN (SELECT r_regionkey, nullif(r_regionkey, 2) AS k FROM region) b ON a.k <=> b.k",
        "SELECT a.n_nationkey, b.r_regionkey FROM (SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation) a JOIN (SELECT r_regionkey, nullif(r_regionkey, 2) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k"),
    "not_in_with_nulls": (["nation", "region"], """SELECT 'a null in the list' AS kind, CAST(count(*) AS BIGINT) AS n FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 3) FROM region WHERE r_regionkey IN (1, 3))
        UNION ALL SELECT 'none', CAST(count(*) AS BIGINT) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 3)
        UNION ALL SELECT 'a null on the left', CAST(count(*) AS BIGINT) FROM nation WHERE nullif(n_regionkey, 0) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 3)""", None),
    "correlated_subquery": (["part", "lineitem"], """SELECT p_partkey, (SELECT CAST(count(*) AS BIGINT) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40) AS big FROM part""", None),
    "common_table_expressions": (["orders"], """WITH y AS (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey), z AS (SELECT avg(m) AS a FROM y)
        SELECT o_custkey, m FROM y, z WHERE m > a * 1.05""", None),
    # sets and rows
    "intersect_all": (["customer", "supplier"], "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", None),
    "except_all": (["customer", "supplier"], "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    "values_rows": (["part"], "SELECT p_partkey, b FROM part LEFT JOIN (VALUES (1, 'x'), (2, NULL), (NULL, 'z')) AS t(a, b) ON p_size = a", None),
    "sort_nulls": (["orders"], "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders ORDER BY s NULLS LAST, o_orderkey DESC LIMIT 30 OFFSET 10", None),
    "pipe_syntax": (["orders"], """FROM orders |> WHERE o_totalprice > 100000 |> AGGREGATE count(*) AS n GROUP BY o_orderpriority |> WHERE n > 1""",
        "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority HAVING count(*) > 1"),
    # scalars
    "dates": (["orders"], """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(dayofyear(o_orderdate) AS BIGINT) AS dy, last_day(CAST(o_orderdate AS DATE)) AS ld,
        CAST(date_add(CAST(o_orderdate AS DATE), 45) AS DATE) AS later, CAST(datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS BIGINT) AS days, date_format(o_orderdate, 'yyyy/MM/dd') AS f FROM orders""",
        """SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS dy, last_day(CAST(o_orderdate AS DATE)) AS ld,
        CAST(CAST(o_orderdate AS DATE) + 45 AS DATE) AS later, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, strftime(o_orderdate, '%Y/%m/%d') AS f FROM orders"""),
    "math": (["part"], """SELECT p_partkey, round(sqrt(p_retailprice), 6) AS r, round(ln(p_retailprice), 6) AS l, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, p_size % 7 AS m,
        abs(p_size - 25) AS a, sign(CAST(p_size - 25 AS DOUBLE)) AS s, round(power(p_size, 1.5), 6) AS pw, greatest(p_size, 10) AS g, least(p_size, 10) AS le, round(atan2(p_size, 3), 9) AS t FROM part""", None),
    "strings_more": (["part"], """SELECT p_partkey, lpad(p_brand, 12, '*') AS lp, reverse(p_type) AS rv, instr(p_type, 'E') AS at, split_part(p_type, ' ', 1) AS w, concat_ws('-', p_brand, p_name) AS cw,
        regexp_replace(p_name, '[aeiou]', '_') AS rr, translate(p_brand, 'Br', 'xy') AS tr, p_type LIKE '%A%' AS lk, initcap(lower(p_brand)) AS ic, md5(p_name) AS h FROM part""",
        """SELECT p_partkey, lpad(p_brand, 12, '*') AS lp, reverse(p_type) AS rv, CAST(instr(p_type, 'E') AS INT) AS at, split_part(p_type, ' ', 1) AS w, concat_ws('-', p_brand, p_name) AS cw,
        regexp_replace(p_name, '[aeiou]', '_', 'g') AS rr, translate(p_brand, 'Br', 'xy') AS tr, p_type LIKE '%A%' AS lk, upper(p_brand[1]) || lower(p_brand[2:]) AS ic, md5(p_name) AS h FROM part"""),
    "generators": (["events"], "SELECT event_id, pos, word FROM events LATERAL VIEW posexplode(split(concat(event_type, ' ', 'of ', user_id), ' ')) AS pos, word",
        "SELECT event_id, CAST(i - 1 AS INT) AS pos, words[i] AS word FROM (SELECT event_id, words, unnest(range(1, len(words) + 1)) AS i FROM (SELECT event_id, string_split(event_type || ' of ' || user_id, ' ') AS words FROM events))"),
    "maps": (["events"], """SELECT event_id, m['type'] AS kind, CAST(size(map_filter(m, (k, v) -> length(v) > 4)) AS BIGINT) AS n, array_join(array_sort(map_keys(m)), ',') AS keys
        FROM (SELECT event_id, map_from_arrays(array('type', 'user'), array(event_type, CAST(user_id AS STRING))) AS m FROM events)""",
        """SELECT event_id, m['type'] AS kind, len(list_filter(map_values(m), lambda v: length(v) > 4)) AS n, array_to_string(list_sort(map_keys(m)), ',') AS keys
        FROM (SELECT event_id, MAP(['type', 'user'], [event_type, CAST(user_id AS VARCHAR)]) AS m FROM events)"""),
    "json_and_variant": (["events"], """SELECT event_id, from_json(props, 'k INT').k AS k, variant_get(parse_json(props), '$.k', 'bigint') AS v, to_json(named_struct('a', user_id)) AS j FROM events""",
        """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS v, '{"a":' || user_id || '}' AS j FROM events"""),
    "csv_and_xml_strings": (["nation"], """SELECT n_nationkey, from_csv(concat(n_nationkey, ',', n_name), 'a INT, b STRING').b AS b, from_xml(concat('<r><c>', n_regionkey, '</c></r>'), 'c INT').c AS c FROM nation""",
        "SELECT n_nationkey, n_name AS b, n_regionkey AS c FROM nation"),
    "arrays": (["embeddings"], """SELECT vec_id, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS up, exists(embedding, x -> x > 2) AS big, element_at(embedding, 3) AS third, array_max(embedding) AS top,
        CAST(size(slice(embedding, 2, 5)) AS BIGINT) AS n, embedding[0] AS head FROM embeddings""",
        """SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS up, len(list_filter(embedding, lambda x: x > 2)) > 0 AS big, embedding[3] AS third, list_max(embedding) AS top,
        len(embedding[2:6]) AS n, embedding[1] AS head FROM embeddings"""),
    "sliding_window": (["events"], "SELECT window.start AS win_start, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY window(ts, '2 hours', '1 hour')",
        """SELECT win_start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS win_start FROM events UNION ALL SELECT time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour' FROM events) GROUP BY win_start"""),
}
