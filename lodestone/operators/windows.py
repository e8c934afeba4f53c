"""Windows: W1-W7."""

from __future__ import annotations

from ..registry import sql_query

_BY = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
sql_query("w1_rank_ntile", f"SELECT o_orderkey, cast(rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS int) AS r, cast(ntile(7) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS int) AS t FROM {{orders}}", tables="orders")
sql_query("w2_top_n", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) t WHERE rn <= 3", tables="orders")
sql_query(
    "w3_offsets",
    f"SELECT o_orderkey, cast(dense_rank() OVER ({_BY}) AS int) AS d, round(percent_rank() OVER ({_BY}), 8) AS pr, round(cume_dist() OVER ({_BY}), 8) AS cd, lag(o_orderkey) OVER ({_BY}) AS lg, lead(o_orderkey, 2) OVER ({_BY}) AS ld, first_value(o_orderkey) OVER ({_BY}) AS fv, nth_value(o_orderkey, 2) OVER ({_BY}) AS nv FROM {{orders}}",
    tables="orders",
)
sql_query("w4_rows", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_BY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM {{orders}}", tables="orders")
sql_query("w5_range", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM {events}", tables="events")
sql_query(
    "w6_groups",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS g FROM {orders})",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders",
    "orders",
)
sql_query(
    "w7_ignore_nulls",
    "SELECT event_id, last_value(IF(event_type = 'purchase', event_id, NULL)) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM {events}",
    "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events",
    "events",
)
