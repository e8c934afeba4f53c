"""User-defined functions: U1-U5. Each runs over Arrow batches."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query, table


#: Rows of a key above which they are aggregated in parts of about so many.
PART = 10_000


@query("u1_scalar", "SELECT o_orderkey, round(o_totalprice * 1.19, 4) AS gross FROM orders")
def scalar(spark, sf_dir):
    @F.arrow_udf("double")
    def gross(price: pa.Array) -> pa.Array:
        return pc.multiply(price, 1.19)

    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(gross("o_totalprice"), 4).alias("gross"))


@query("u2_udaf", "SELECT user_id, round(max(value) - min(value), 6) AS spread FROM events GROUP BY user_id")
def udaf(spark, sf_dir):
    """Three user-defined aggregates: a hot key's rows are aggregated in parts of about PART rows first, so that they don't meet. Other keys are one
    part, as each part is a call of its own."""

    @F.pandas_udf("double")
    def lowest(value: pd.Series) -> float:
        return value.min()

    @F.pandas_udf("double")
    def highest(value: pd.Series) -> float:
        return value.max()

    @F.pandas_udf("double")
    def spread(low: pd.Series, high: pd.Series) -> float:
        return high.max() - low.min()

    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    # at most one hot key for each PART rows
    hot = events.groupBy(F.col("user_id").alias("hot")).agg(F.ceil(F.count(F.lit(1)) / PART).alias("splits")).where("splits > 1")
    dealt = events.join(F.broadcast(hot), F.col("user_id").eqNullSafe(F.col("hot")), "left")
    whole = lambda low, high: F.round(spread(low, high), 6).alias("spread")
    split = F.pmod(F.xxhash64("event_id"), F.col("splits")).alias("split")
    parts = dealt.where("splits IS NOT NULL").groupBy("user_id", split).agg(lowest("value").alias("low"), highest("value").alias("high"))
    few = dealt.where("splits IS NULL").groupBy("user_id").agg(whole("value", "value"))
    return few.union(parts.groupBy("user_id").agg(whole("low", "high")))


@query("u2_udaf_window", "SELECT event_id, round(max(value) OVER w - min(value) OVER w, 6) AS spread FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def udaf_window(spark, sf_dir):
    @F.pandas_udf("double")
    def spread(value: pd.Series) -> float:
        return value.max() - value.min()

    last = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(spread("value").over(last), 6).alias("spread"))


@query("u3_udtf", "SELECT r_regionkey, i::INTEGER AS i FROM region, range(0, 3) t(i) WHERE i <= r_regionkey")
def udtf(spark, sf_dir):
    @F.udtf(returnType="i int")
    class Upto:
        def eval(self, n: int):
            for i in range(min(n, 2) + 1):
                yield (i,)

    spark.udtf.register("upto", Upto)
    return spark.sql("SELECT r_regionkey, i FROM {region}, LATERAL upto(r_regionkey)", region=table(spark, sf_dir, "region"))


@query("u4_map_arrow", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 48")
def map_arrow(spark, sf_dir):
    def keep(batches):
        for batch in batches:
            yield batch.filter(pc.greater(batch.column(1), 48))

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").mapInArrow(keep, "l_orderkey bigint, l_quantity double")


@query("u1_plain", "SELECT n_nationkey, n_name || '!' AS loud, length(n_name)::BIGINT AS n FROM nation")
def plain(spark, sf_dir):
    """A row at a time, and a batch of rows at a time as pandas."""

    @F.udf("string")
    def loud(name):
        return f"{name}!"

    @F.pandas_udf("bigint")
    def size(name: pd.Series) -> pd.Series:
        return name.str.len()

    return table(spark, sf_dir, "nation").select("n_nationkey", loud("n_name").alias("loud"), size("n_name").alias("n"))


@query("u4_map_pandas", "SELECT s_suppkey, round(s_acctbal * 2, 2) AS twice FROM supplier WHERE s_acctbal > 0")
def map_pandas(spark, sf_dir):
    def twice(frames):
        for frame in frames:
            some = frame[frame.s_acctbal > 0]
            yield pd.DataFrame({"s_suppkey": some.s_suppkey, "twice": (some.s_acctbal * 2).round(2)})

    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").mapInPandas(twice, "s_suppkey bigint, twice double")


#: Neighbouring keys whose rows one call of a grouped map gets: a call costs more than a key's few rows.
KEYS = 256


def blocks(frame, key: str):
    """The frame with the number of each row's block of keys."""
    return frame.withColumn("block", F.expr(f"{key} div {KEYS}"))


@query("u4_grouped_pandas", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey) - o_totalprice, 2) AS rest FROM orders")
def grouped_pandas(spark, sf_dir):
    """A block of customers and their orders are held at once; they are few."""

    def others(frame: pd.DataFrame) -> pd.DataFrame:
        total = frame.groupby("o_custkey", dropna=False).o_totalprice.transform("sum")
        return pd.DataFrame({"o_custkey": frame.o_custkey, "o_orderkey": frame.o_orderkey, "rest": (total - frame.o_totalprice).round(2) + 0.0})

    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return blocks(orders, "o_custkey").groupBy("block").applyInPandas(others, "o_custkey bigint, o_orderkey bigint, rest double")


@query("u4_grouped_arrow", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1")
def grouped_arrow(spark, sf_dir):
    def top(rows: pa.Table) -> pa.Table:
        found = rows.group_by("o_custkey").aggregate([([], "count_all"), ("o_totalprice", "max")])
        return pa.table({"o_custkey": found["o_custkey"], "n": found["count_all"], "top": found["o_totalprice_max"]})

    return blocks(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), "o_custkey").groupBy("block").applyInArrow(top, "o_custkey bigint, n bigint, top double")


@query("u4_cogroup", "SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS events FROM customer")
def cogroup(spark, sf_dir):
    """Customers with the numbers of their orders and events; a key's rows are counted before they are sent."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    left = keys.join(orders, "k", "left").fillna(0, "n")

    def both(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        # a null key meets no events
        found = one.k.map(two.set_index("k").n).where(one.k.notna()).fillna(0).astype("int64")
        return pd.DataFrame({"k": one.k, "orders": one.n, "events": found})

    return blocks(left, "k").groupBy("block").cogroup(blocks(events, "k").groupBy("block")).applyInPandas(both, "k bigint, orders bigint, events bigint")


@query("u5_sql_function", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side FROM customer")
def sql_function(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION side_of(x DOUBLE) RETURNS STRING RETURN CASE WHEN x < 0 THEN 'debt' ELSE 'credit' END")
    return spark.sql("SELECT c_custkey, side_of(c_acctbal) AS side FROM {customer}", customer=table(spark, sf_dir, "customer"))
