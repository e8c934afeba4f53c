"""Order statistics of few keys with many rows: W1, A5 and A6.

A window or an exact percentile by key gives each key to one task. Here rows are dealt by ranges of key and order, so that a key
has as many tasks as it has ranges, and what a range needs to know of those before it comes from a table with a row for each range and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, table
from ..shared import written

#: Bars of a histogram pass; values that a pass may leave to be sorted.
BARS, LEFT = 1_024, 10_000
_GREATEST = 1.7976931348623157e308


def numbered(rows: DataFrame, key: str, by: list[str], falling: bool = False) -> DataFrame:
    """The rows with three columns more: number (from 1 in the order of by, within the key), rank (1 and how many rows
    of the key come before in the order of by[0] alone) and of (rows of the key). Ties of by have numbers in any order. Nulls come first,
    last if falling; a null key is a key. New columns replace ones of the same name."""
    order = [F.desc_nulls_last(c) if falling else F.asc_nulls_first(c) for c in (f"x.`{c}`" for c in by)]
    whole = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("x"), F.col(f"`{key}`").alias("k"))
    dealt = written(whole.repartitionByRange("k", *order).withColumn("part", F.spark_partition_id()))
    own, value = Window.partitionBy("part", "k"), f"x.`{by[0]}`"
    local = dealt.withColumns({"at": F.row_number().over(own.orderBy(*order)), "from": F.rank().over(own.orderBy(order[0]))})
    # a range's last run of equal values, and whether the range is one run
    ends = local.groupBy("part", "k").agg(F.count(F.lit(1)).alias("n"), F.max_by("from", "at").alias("run"), F.max_by(F.struct(F.col(value).alias("v")), "at").alias("last"), F.min_by(F.struct(F.col(value).alias("v")), "at").alias("first"))
    before = Window.partitionBy("k").orderBy("part")
    ends = ends.withColumns({"skip": F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "of": F.sum("n").over(Window.partitionBy("k")), "goes_on": F.coalesce(F.col("first").eqNullSafe(F.lag("last").over(before)) & F.lag("n").over(before).isNotNull(), F.lit(False))})
    begins = F.when(~(F.col("goes_on") & (F.col("run") == 1)), F.col("skip") + F.col("run"))
    ends = ends.withColumn("since", F.last(begins, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
    met = local.join(ends.select(F.col("part").alias("p"), F.col("k").alias("j"), "skip", "of", "goes_on", "since"), F.col("part").eqNullSafe(F.col("p")) & F.col("k").eqNullSafe(F.col("j")))
    rank = F.when(F.col("goes_on") & (F.col("from") == 1), F.col("since")).otherwise(F.col("skip") + F.col("from"))
    kept = [f"x.`{c}`" for c in rows.columns if c not in ("number", "rank", "of")]
    return met.select(*kept, (F.col("skip") + F.col("at")).alias("number"), rank.alias("rank"), "of")


def tile(tiles: int) -> F.Column:
    """ntile(tiles) of a numbered row."""
    size, more = f"(of div {tiles})", f"(of % {tiles})"
    return F.expr(f"CASE WHEN number <= {more} * ({size} + 1) THEN (number - 1) div ({size} + 1) + 1 ELSE {more} + (number - 1 - {more} * ({size} + 1)) div {size} + 1 END")


def quantiles(rows: DataFrame, key: str, value: str, shares: list[float], bars: int = BARS, left: int = LEFT) -> DataFrame:
    """key, share and quantile: between the two values whose places are nearest to share * (n - 1), as percentile_cont has it.

    Each pass counts the values of a key's open range in bars and keeps the bar that holds the place sought, down to its own least and greatest
    value. Only what is left of the last range, at most `left` values, is sorted. Null values count as none, and a key without values has
    no row; NaN is above all numbers, infinite values count as the greatest doubles. A null key is a key."""
    values = rows.where(F.col(f"`{value}`").isNotNull()).select(F.struct(F.col(f"`{key}`").alias("k")).alias("k"), F.col(f"`{value}`").cast("double").alias("v"))
    values = values.withColumn("v", F.when(F.isnan("v"), F.col("v")).otherwise(F.greatest(F.least("v", F.lit(_GREATEST)), F.lit(-_GREATEST))))
    number, kinds = F.when(~F.isnan("v"), F.col("v")), F.array(*(F.lit(float(s)) for s in shares))
    sought = values.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count(number).alias("held"), F.min(number).alias("low"), F.max(number).alias("high"))
    sought = sought.withColumn("share", F.explode(F.array_distinct(kinds))).withColumn("place", F.col("share") * (F.col("n") - 1))
    sought = sought.select("*", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("r")).withColumn("below", F.lit(0).cast("bigint"))
    sought = written(sought)
    beyond = sought.where("r >= held").select("k", "share", "place", "r", F.lit(float("nan")).alias("q"))
    open_, done = sought.where("r < held"), []
    numbers = values.where(~F.isnan("v"))
    while True:
        ended = "low = high"
        done.append(open_.where(ended).select("k", "share", "place", "r", F.col("low").alias("q")))
        open_ = open_.where(f"NOT ({ended})")
        few = open_.where(F.col("held") <= left)
        inside = numbers.join(few, "k").where("v BETWEEN low AND high")
        place = F.row_number().over(Window.partitionBy("k", "share", "r").orderBy("v"))
        done.append(inside.withColumn("at", place).where("at = r - below + 1").select("k", "share", "place", "r", F.col("v").alias("q")))
        open_ = open_.where(F.col("held") > left)
        if open_.isEmpty():
            break
        # halves, as the range may be wider than the greatest double
        bar = f"least({bars - 1}, cast(floor((v / 2 - low / 2) / (high / 2 - low / 2) * {bars}) AS int))"
        counts = numbers.join(open_, "k").where("v BETWEEN low AND high").groupBy("k", "share", "place", "r", "below", F.expr(bar).alias("bar")).agg(F.count(F.lit(1)).alias("held"), F.min("v").alias("low"), F.max("v").alias("high"))
        until = F.sum("held").over(Window.partitionBy("k", "share", "r").orderBy("bar"))
        counts = counts.withColumn("until", F.col("below") + until).where("until > r AND until - held <= r")
        open_ = written(counts.select("k", "share", "place", "r", (F.col("until") - F.col("held")).alias("below"), "held", "low", "high"))
    found = beyond
    for more in done:
        found = found.unionAll(more)
    ends = found.groupBy("k", "share", "place").agg(F.min_by("q", "r").alias("a"), F.max_by("q", "r").alias("b"))
    return ends.select(F.col("k.k").alias(key), "share", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("quantile"))


@query("a6_percentiles", "SELECT event_type, s AS share, round(CASE s WHEN 0.0 THEN percentile_cont(0) WITHIN GROUP (ORDER BY value) WHEN 0.1 THEN percentile_cont(0.1) WITHIN GROUP (ORDER BY value) WHEN 0.9 THEN percentile_cont(0.9) WITHIN GROUP (ORDER BY value) ELSE percentile_cont(1) WITHIN GROUP (ORDER BY value) END, 6) AS q FROM events, (VALUES (0.0::DOUBLE), (0.1), (0.9), (1.0)) t(s) GROUP BY event_type, s")
def percentiles(spark, sf_dir):
    found = quantiles(table(spark, sf_dir, "events"), "event_type", "value", [0.0, 0.1, 0.9, 1.0])
    return found.select("event_type", "share", F.round("quantile", 6).alias("q"))


@query("a5_medians", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS med FROM lineitem GROUP BY 1")
def medians(spark, sf_dir):
    return quantiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", [0.5]).select("l_returnflag", F.round("quantile", 4).alias("med"))


@query(
    "w1_ranks_of_few_keys",
    "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC) AS r, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, ntile(7) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS t FROM orders",
)
def ranks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    found = numbered(orders, "o_orderpriority", ["o_orderdate", "o_orderkey"], falling=True)
    return found.select("o_orderkey", F.col("rank").alias("r"), F.col("number").alias("rn"), tile(7).alias("t"))
