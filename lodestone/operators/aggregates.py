"""Aggregation: A2-A10 (A1 is in plans)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, sql_query, table
from ..shared import written

sql_query("a2_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM {lineitem} GROUP BY l_returnflag", tables="lineitem")
for _kind, _by in (("cube", "CUBE (o_orderstatus, o_orderpriority)"), ("rollup", "ROLLUP (o_orderstatus, o_orderpriority)"), ("sets", "GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")):
    sql_query(f"a3_{_kind}", f"SELECT o_orderstatus, o_orderpriority, cast(grouping(o_orderstatus) AS int) AS g, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {{orders}} GROUP BY {_by}", tables="orders")
sql_query("a4_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 100000) AS high, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS f FROM {orders} GROUP BY o_orderpriority", tables="orders")
sql_query("a5_spread", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(variance(l_quantity), 6) AS va, round(median(l_quantity), 4) AS med FROM {lineitem} GROUP BY l_returnflag", tables="lineitem")
sql_query("a6_percentile", "SELECT event_type, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY value), 6) AS p90 FROM {events} GROUP BY event_type", tables="events")
sql_query(
    "a7_moments",
    "SELECT event_type, round((avg(value * value * value) - 3 * avg(value) * avg(value * value) + 2 * power(avg(value), 3)) / power(avg(value * value) - power(avg(value), 2), 1.5), 5) AS skew FROM {events} GROUP BY event_type",
    tables="events",
)
sql_query("a9_lists", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1", "nation")
sql_query(
    "a10_more",
    "SELECT o_orderstatus, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top, round(corr(o_totalprice, o_custkey), 6) AS r, round(covar_pop(o_totalprice, o_custkey), 0) AS cov, round(regr_slope(o_totalprice, o_custkey), 6) AS slope, bool_and(o_totalprice > 0) AS pos, bit_and(o_orderkey) AS bits, count_if(o_totalprice > 1000) AS big FROM {orders} GROUP BY o_orderstatus",
    "SELECT o_orderstatus, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS top, round(corr(o_totalprice, o_custkey), 6) AS r, round(covar_pop(o_totalprice, o_custkey), 0) AS cov, round(regr_slope(o_totalprice, o_custkey), 6) AS slope, bool_and(o_totalprice > 0) AS pos, bit_and(o_orderkey) AS bits, count(*) FILTER (WHERE o_totalprice > 1000) AS big FROM orders GROUP BY 1",
    "orders",
)


sql_query(
    "a5_mode",
    "SELECT l_returnflag, mode() WITHIN GROUP (ORDER BY l_quantity) AS often FROM {lineitem} GROUP BY l_returnflag",
    "SELECT l_returnflag, arg_min(l_quantity, struct_pack(n := -n, q := l_quantity)) AS often FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1",
    "lineitem",
)
_M1, _M2, _M3, _M4 = ("avg(value)", "avg(value * value)", "avg(value * value * value)", "avg(value * value * value * value)")
sql_query(
    "a7_kurtosis",
    f"SELECT event_type, round(({_M4} - 4 * {_M1} * {_M3} + 6 * {_M1} * {_M1} * {_M2} - 3 * power({_M1}, 4)) / power({_M2} - {_M1} * {_M1}, 2) - 3, 4) AS kurt FROM {{events}} GROUP BY event_type",
    tables="events",
)
sql_query("a7_built_in", "SELECT event_type, abs(skewness(value) - (avg(value * value * value) - 3 * avg(value) * avg(value * value) + 2 * power(avg(value), 3)) / power(avg(value * value) - power(avg(value), 2), 1.5)) < 1e-6 AS skew_same, "
    f"abs(kurtosis(value) - (({_M4} - 4 * {_M1} * {_M3} + 6 * {_M1} * {_M1} * {_M2} - 3 * power({_M1}, 4)) / power({_M2} - {_M1} * {_M1}, 2) - 3)) < 1e-6 AS kurt_same FROM {{events}} GROUP BY event_type",
    "SELECT event_type, true AS skew_same, true AS kurt_same FROM events GROUP BY 1", "events")
sql_query(
    "a9_sets",
    "SELECT o_orderstatus, array_join(array_sort(collect_set(o_orderpriority)), '|') AS prios, listagg(o_orderpriority, ';') WITHIN GROUP (ORDER BY o_orderpriority) AS listed, string_agg(o_orderpriority, ',') WITHIN GROUP (ORDER BY o_orderpriority DESC) AS falling FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}) GROUP BY o_orderstatus",
    "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS prios, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS listed, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority DESC) AS falling FROM orders GROUP BY 1",
    "orders",
)
sql_query(
    "a10_least",
    "SELECT event_type, min_by(event_id, struct(value, event_id)) AS least, bit_or(event_id) AS ors, bit_xor(event_id) AS xors, bool_or(value > 99) AS some, every(value >= 0) AS all_up, round(covar_samp(value, event_id), 2) AS cov, round(regr_intercept(value, event_id), 4) AS at_zero, cast(regr_count(value, event_id) AS bigint) AS n FROM {events} GROUP BY event_type",
    "SELECT event_type, arg_min(event_id, struct_pack(v := value, e := event_id)) AS least, bit_or(event_id) AS ors, bit_xor(event_id) AS xors, bool_or(value > 99) AS some, bool_and(value >= 0) AS all_up, round(covar_samp(value, event_id), 2) AS cov, round(regr_intercept(value, event_id), 4) AS at_zero, regr_count(value, event_id)::BIGINT AS n FROM events GROUP BY 1",
    "events",
)
#: A histogram's bars hold all rows, and their mean is that of the values.
sql_query(
    "a10_histogram",
    "SELECT event_type, size(h) <= 20 AS few, cast(round(aggregate(h, 0D, (a, b) -> a + b.y)) AS bigint) AS n, round(aggregate(h, 0D, (a, b) -> a + b.x * b.y) / n, 3) AS mean FROM (SELECT event_type, histogram_numeric(value, 20) AS h, count(*) AS n FROM {events} GROUP BY event_type)",
    "SELECT event_type, true AS few, count(*) AS n, round(avg(value), 3) AS mean FROM events GROUP BY 1",
    "events",
)


@query("a8_sketches", "SELECT l_returnflag, true AS parts, true AS hll, true AS theta, true AS med, true AS kll FROM lineitem GROUP BY 1")
def sketches(spark, sf_dir):
    """Whether approximate distinct counts are within 15 % of the exact ones and approximate medians within 5 % of the
    ranks; the estimates themselves differ from engine to engine."""
    lines = table(spark, sf_dir, "lineitem")
    # an exact distinct count beside sketches would give every distinct value sketches of its own
    exact = lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"))
    near = lines.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n")).groupBy("l_returnflag").agg(F.percentile("l_quantity", F.array(F.lit(0.45), F.lit(0.55)), F.col("n")).alias("near"))
    found = lines.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey").alias("a"),
        F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("b"),
        F.theta_sketch_estimate(F.theta_sketch_agg("l_partkey")).alias("c"),
        F.percentile_approx("l_quantity", 0.5).alias("d"),
        F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("l_quantity"), F.lit(0.5)).alias("e"),
    )
    for more in (exact, near):
        more = more.withColumnRenamed("l_returnflag", "flag")
        found = found.join(more, F.col("l_returnflag").eqNullSafe(F.col("flag"))).drop("flag")
    close = lambda c: F.abs(F.col(c) - F.col("exact")) <= 0.15 * F.col("exact")
    middle = lambda c: F.col(c).between(F.col("near")[0] - 1, F.col("near")[1] + 1)
    return found.select("l_returnflag", close("a").alias("parts"), close("b").alias("hll"), close("c").alias("theta"), middle("d").alias("med"), middle("e").alias("kll"))


def sketched(rows, keys: list[str], counted: str, measured: str):
    """A row for each group with sketches of the distinct values of one column (hll, theta) and of another's ranks (kll), and its rows (n). They
    are small, can be stored, and groups of groups merge them without reading the rows again."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(counted, 12).alias("hll"), F.theta_sketch_agg(counted, 14).alias("theta"), F.kll_sketch_agg_double(measured).alias("kll"))


@query(
    "a8_merged_sketches",
    "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, true AS hll_near, true AS theta_near, true AS kll_near FROM lineitem GROUP BY 1",
)
def merged_sketches(spark, sf_dir):
    """Sketches by flag and quarter, stored as Parquet, read back and merged by flag; beside the exact counts whether the merged estimates
    are within 5 % of them, and the merged quartiles within 2 % of the ranks."""
    lines = table(spark, sf_dir, "lineitem").withColumn("quarter", F.date_trunc("quarter", F.col("l_shipdate").cast("timestamp")))
    stored = written(sketched(lines, ["l_returnflag", "quarter"], "l_partkey", "l_extendedprice"))
    merged = stored.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("hll"), F.theta_sketch_estimate(F.theta_union_agg("theta")).alias("theta"), F.kll_merge_agg_double("kll").alias("kll"))
    quartiles = [F.kll_sketch_get_quantile_double("kll", F.lit(s)).alias(f"q{i}") for i, s in enumerate((0.25, 0.5, 0.75))]
    merged = merged.select("l_returnflag", "n", "hll", "theta", *quartiles)
    below = [F.count_if(F.col("l_extendedprice") <= F.col(f"q{i}")).alias(f"below{i}") for i in range(3)]
    exact = lines.join(merged, "l_returnflag").groupBy("l_returnflag", "n", "hll", "theta").agg(F.count_distinct("l_partkey").alias("parts"), *below)
    near = lambda c: F.abs(F.col(c) - F.col("parts")) <= 0.05 * F.col("parts")
    ranks = F.greatest(*(F.abs(F.col(f"below{i}") / F.col("n") - 0.25 * (i + 1)) for i in range(3)))
    return exact.select("l_returnflag", "n", "parts", near("hll").alias("hll_near"), near("theta").alias("theta_near"), (ranks <= 0.02).alias("kll_near"))


@query("a8_theta_overlap", "SELECT count(*) AS shared, true AS near FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def theta_overlap(spark, sf_dir):
    """Parts that two flags share: the intersection of their stored sketches, beside the exact number, within 5 % of the union."""
    lines = table(spark, sf_dir, "lineitem")
    stored = written(lines.groupBy("l_returnflag").agg(F.theta_sketch_agg("l_partkey", 14).alias("theta")))
    side = lambda flag, name: stored.where(F.col("l_returnflag") == flag).select(F.col("theta").alias(name))
    both = side("A", "a").crossJoin(side("R", "r")).select(F.theta_sketch_estimate(F.theta_intersection("a", "r")).alias("met"), F.theta_sketch_estimate(F.theta_union("a", "r")).alias("all"))
    parts = lambda flag: lines.where(F.col("l_returnflag") == flag).select("l_partkey")
    exact = parts("A").intersect(parts("R")).agg(F.count(F.lit(1)).alias("shared"))
    return exact.crossJoin(both).select("shared", (F.abs(F.col("met") - F.col("shared")) <= 0.05 * F.col("all")).alias("near"))
