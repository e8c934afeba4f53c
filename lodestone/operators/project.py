"""Projection, filter and reshape: P1-P7, and sorts and limits: L1, L2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, sql_query, table
from ..shared import conf, written

sql_query("p1_project_filter", "SELECT o_orderkey, round(o_totalprice * 0.5, 4) AS half, upper(o_orderpriority) AS prio FROM {orders} WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderstatus IN ('O', 'P')", tables="orders")
sql_query(
    "p2_pivot",
    "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM {orders}) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
    "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1",
    "orders",
)
sql_query(
    "p2_unpivot",
    "SELECT s_suppkey, what, amount FROM (SELECT s_suppkey, s_acctbal AS bal, s_acctbal * 2 AS twice FROM {supplier}) UNPIVOT (amount FOR what IN (bal, twice))",
    "SELECT s_suppkey, 'bal' AS what, s_acctbal AS amount FROM supplier UNION ALL SELECT s_suppkey, 'twice', s_acctbal * 2 FROM supplier",
    "supplier",
)
sql_query("p3_posexplode", "SELECT vec_id, posexplode(embedding) AS (pos, x) FROM {embeddings}", "SELECT vec_id, (unnest(range(1, len(embedding) + 1)) - 1)::INTEGER AS pos, unnest(embedding) AS x FROM embeddings", "embeddings")
sql_query("p3_explode", "SELECT event_id, explode(split(props, '\"')) AS part FROM {events}", "SELECT event_id, unnest(string_split(props, '\"')) AS part FROM events", "events")
sql_query("p3_explode_outer", "SELECT n_nationkey, explode_outer(filter(array(n_name, 'x'), v -> n_regionkey > 1 AND v <> 'x')) AS v FROM {nation}", "SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_name END AS v FROM nation", "nation")
sql_query("p3_inline", "SELECT n_nationkey, inline(array(named_struct('k', 'name', 'v', n_name), named_struct('k', 'key', 'v', cast(n_nationkey AS string)))) FROM {nation}", "SELECT n_nationkey, 'name' AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'key', n_nationkey::VARCHAR FROM nation", "nation")
sql_query("p3_stack", "SELECT n_nationkey, stack(2, 'name', n_name, 'region', cast(n_regionkey AS string)) AS (k, v) FROM {nation}", "SELECT n_nationkey, 'name' AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey::VARCHAR FROM nation", "nation")
sql_query("p5_qualify", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) WHERE rn = 1", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1", "orders")
sql_query("p6_pipe", "FROM {customer} |> WHERE c_acctbal > 0 |> AGGREGATE count(*) AS n, round(sum(c_acctbal), 2) AS bal GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer WHERE c_acctbal > 0 GROUP BY 1", "customer")
# up to five steps from each customer's first order to the next
_WALK = "WITH RECURSIVE placed AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step FROM {orders}), walk(o_custkey, o_orderkey, step, total) AS (SELECT o_custkey, o_orderkey, step, o_totalprice FROM placed WHERE step = 1 UNION ALL SELECT p.o_custkey, p.o_orderkey, p.step, w.total + p.o_totalprice FROM walk w JOIN placed p ON p.o_custkey = w.o_custkey AND p.step = w.step + 1 WHERE w.step < 5) "
_WALKED = _WALK + "SELECT o_custkey, o_orderkey, cast(step AS int) AS step, round(total, 2) AS total FROM walk"
sql_query("l1_sort_limit_offset", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 25", tables="customer")
sql_query("l2_top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", tables="orders")


@query("p7_recursive", _WALKED.replace("{orders}", "orders"))
def recursive(spark, sf_dir):
    """The limit on a recursion's rows (a million) is read as it runs, so it runs here; its steps are limited by the condition on step."""
    with conf(spark, spark__sql__cteRecursionRowLimit="-1"):
        return written(spark.sql(_WALKED, orders=table(spark, sf_dir, "orders")))


@query("p4_sample", "SELECT true AS repeated, true AS within")
def sample(spark, sf_dir):
    """Whether a sample of a tenth of the lines is the same when drawn again, and within six standard deviations of a tenth.
    Which lines are drawn is up to the engine."""
    lines = table(spark, sf_dir, "lineitem")
    drawn = lambda name: lines.sample(fraction=0.1, seed=7).agg(F.count(F.lit(1)).alias(f"{name}_n"), F.sum("l_extendedprice").alias(f"{name}_sum"))
    both = drawn("a").crossJoin(drawn("b")).crossJoin(lines.agg(F.count(F.lit(1)).alias("n")))
    same = (F.col("a_n") == F.col("b_n")) & (F.round("a_sum", 2) == F.round("b_sum", 2))
    return both.select(same.alias("repeated"), (F.abs(F.col("a_n") - 0.1 * F.col("n")) <= 6 * F.sqrt(0.09 * F.col("n"))).alias("within"))
