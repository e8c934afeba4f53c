"""Whole plans: the star join and the pricing summary."""

from __future__ import annotations

from ..registry import sql_query

sql_query(
    "j1_star_revenue",
    """
    SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, count(*) AS n_lines
    FROM {lineitem} l
    JOIN {orders} o ON l.l_orderkey = o.o_orderkey
    JOIN {customer} c ON o.o_custkey = c.c_custkey
    JOIN {supplier} s ON l.l_suppkey = s.s_suppkey AND s.s_nationkey = c.c_nationkey
    JOIN {nation} n ON s.s_nationkey = n.n_nationkey
    JOIN {region} r ON n.n_regionkey = r.r_regionkey
    GROUP BY n.n_name
    """,
    tables="lineitem orders customer supplier nation region",
)

sql_query(
    "a1_pricing_summary",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
           round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
    GROUP BY l_returnflag, l_linestatus
    """,
    tables="lineitem",
)
