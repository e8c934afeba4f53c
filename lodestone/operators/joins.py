"""Joins: J1-J13."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType

from ..registry import query, sql_query, table

_BY_SEGMENT = "SELECT {hint} c.c_mktsegment, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment"
for _name, _hint in (("j1_broadcast", "/*+ BROADCAST(n) */"), ("j2_sort_merge", "/*+ MERGE(c) */"), ("j3_shuffled_hash", "/*+ SHUFFLE_HASH(c) */")):
    if _name == "j1_broadcast":
        # nation is a fixed table of 25 rows
        sql_query(_name, f"SELECT {_hint} n.n_name, count(*) AS n FROM {{customer}} c JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", tables="customer nation")
    else:
        sql_query(_name, _BY_SEGMENT.format(hint=_hint).replace("{{", "{").replace("}}", "}"), tables="orders customer")

for _kind in ("LEFT", "RIGHT", "FULL OUTER"):
    # orders without lines are on the kept side
    _ends = "{lineitem} l RIGHT JOIN {orders} o" if _kind == "RIGHT" else f"{{orders}} o {_kind} JOIN {{lineitem}} l"
    sql_query(f"j4_{_kind.split()[0].lower()}", f"SELECT o.o_orderkey AS ok, l.l_orderkey AS lk, o_totalprice, l_quantity FROM {_ends} ON o.o_orderkey = l.l_orderkey", tables="orders lineitem")
sql_query("j4_cross", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n", tables="region nation")
sql_query("j5_semi", "SELECT o_orderkey FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)", tables="orders lineitem")
sql_query("j6_anti", "SELECT o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey)", tables="orders lineitem")
sql_query("j8_theta", "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey", tables="nation")
sql_query("j9_lateral", "SELECT c.c_custkey, t.n, t.top FROM {customer} c, LATERAL (SELECT count(*) AS n, max(o.o_totalprice) AS top FROM {orders} o WHERE o.o_custkey = c.c_custkey) t", tables="customer orders")
sql_query("j10_scalar_subquery", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)", tables="orders")


def not_in(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """Rows of left whose key is NOT IN right's column. Spark's own plan broadcasts the whole column, to know of its nulls; here one row says
    whether it has any rows and nulls, and the rest is an anti join of any size."""
    said = right.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.col(other).isNull()).alias("_nulls"))
    values = right.select(F.col(other).alias("_other"))
    kept = left.join(values, F.col(key) == F.col("_other"), "left_anti").join(F.broadcast(said))
    return kept.where((F.col("_rows") == 0) | (F.col("_nulls") == 0) & F.col(key).isNotNull()).select(*left.columns)


@query("j7_not_in", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orders_not_in_lines(spark, sf_dir):
    return not_in(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey")


#: Blocks of time into which a key's rows are dealt.
TIME_BLOCKS = 1_024


def _number(column: Column, kind: DataType) -> Column:
    """A time as a double that orders as the time does; 0 for types that have no such number."""
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        start = F.expr("timestamp_ntz '1970-01-01 00:00:00'" if isinstance(kind, TimestampNTZType) else "timestamp '1970-01-01 00:00:00'")
        return F.timestamp_diff("MICROSECOND", start, column.cast("timestamp") if isinstance(kind, DateType) else column).cast("double")
    return column.cast("double") if isinstance(kind, NumericType) else F.lit(0.0)


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_id: str, blocks: int = TIME_BLOCKS) -> DataFrame:
    """Each left row with the id of the latest right row of its key at or before its time, null if there is none; of
    equal times the largest id. Rows with a null key or time match nothing and aren't shuffled.

    Rows are shuffled once, by key and block of time, so a key with many rows has many tasks. A right row that no block of
    its own decides comes from an earlier one: the last right row of each block is carried forward in a table of one row for each key and block."""
    row = F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("row")
    kind, good = right.schema[right_id].dataType, F.col(key).isNotNull() & F.col(left_time).isNotNull()
    both = left.where(good).select(row, F.col(key).alias("k"), F.col(left_time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("met"))
    known = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull() & F.col(right_id).isNotNull())
    both = both.unionByName(known.select(F.lit(None).cast(both.schema["row"].dataType).alias("row"), F.col(key).alias("k"), F.col(right_time).alias("t"), F.lit(-1).alias("side"), F.col(right_id).alias("met")))
    time = _number(F.col("t"), both.schema["t"].dataType)
    low, high = both.select(time.alias("n")).where("n = n AND abs(n) < double('Infinity')").agg(F.min("n"), F.max("n")).first()
    block = F.lit(0)
    if low is not None and high > low:
        # NaN is after all times
        block = F.when(F.isnan(time), blocks).otherwise(F.least(F.greatest(F.floor((time - low) / (high - low) * blocks), F.lit(0)), F.lit(blocks)))
    both = both.withColumn("block", block.cast("int"))
    order = Window.partitionBy("k", "block").orderBy("t", "side", F.col("met").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("met", F.last("met", ignorenulls=True).over(order)).where("side = 1").select("row", "met", "k", "block")
    ends = both.groupBy("k", "block").agg(F.max(F.when(F.col("side") == -1, F.struct("t", "met"))).alias("last"))
    before = Window.partitionBy("k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("k", "block", F.last("last.met", ignorenulls=True).over(before).alias("carried"))
    found = found.join(carried, ["k", "block"], "left").select("row", F.coalesce("met", "carried").alias("met"))
    lone = left.where(~good | good.isNull()).select(row, F.lit(None).cast(kind).alias("met"))
    return found.unionByName(lone).select("row.*", F.col("met").alias(right_id))


@query(
    "j11_as_of",
    "SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, ts FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate",
)
def as_of_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderdate", "o_orderkey")
    return as_of(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), orders, "user_id", "ts", "o_orderdate", "o_orderkey").select("event_id", "o_orderkey")


# all earlier orders of a user meet each event of theirs: as_of() is for keys with many rows
sql_query(
    "j12_correlated_as_of",
    "SELECT e.event_id, max_by(o.o_orderkey, struct(o.o_orderdate, o.o_orderkey)) AS o_orderkey FROM {events} e LEFT JOIN {orders} o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts GROUP BY e.event_id",
    "SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id, ts FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate",
    "events orders",
)


#: Levels of a range join: each has buckets twice as wide as the one before.
LEVELS = 40


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point < high. Columns may have any name.

    A span goes to the level whose buckets are at least as wide as it is (width, twice, four times and so on), and there to the buckets that it touches, two at
    most (three, where rounding has it so). Points meet the levels that spans are on, in one bucket each; spans wider than all levels, or with an infinite
    bound, are on a last level of one bucket. A null or NaN point is in no span; a span with a null or NaN bound, or one not above the other, holds none."""
    own, other = (F.struct(*(F.col(f"`{c}`") for c in frame.columns)) for frame in (points, spans))
    side = lambda c: F.col(f"`{c}`").cast("double")
    good = spans.where((F.col(f"`{low}`") < F.col(f"`{high}`")) & ~F.isnan(side(low)) & ~F.isnan(side(high)))
    wide = (side(high) - side(low)) / width
    # a bucket's number must be exact, so far-off bounds are on the last level too
    far = (wide > 2.0 ** (LEVELS - 1)) | (F.greatest(F.abs(side(low)), F.abs(side(high))) / width > 2.0**52)
    level = F.when(far, LEVELS).otherwise(F.ceil(F.log2(F.greatest(wide, F.lit(1.0))))).cast("int")
    bucket = lambda c, level: F.when(level < LEVELS, F.floor(c / (width * F.pow(F.lit(2.0), level)))).otherwise(0)
    dealt = good.select(other.alias("span"), level.alias("level"), side(low).alias("l"), side(high).alias("h"))
    dealt = dealt.select("span", "level", F.explode(F.sequence(bucket(F.col("l"), F.col("level")), bucket(F.col("h"), F.col("level")))).alias("bucket"))
    levels = sorted(r.level for r in dealt.select("level").distinct().collect())
    at = points.where(F.col(f"`{point}`").isNotNull() & ~F.isnan(side(point))).select(own.alias("point"), side(point).alias("p"), F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    met = at.select("point", "level", bucket(F.col("p"), F.col("level")).alias("bucket")).join(dealt, ["level", "bucket"])
    inside = (F.col(f"point.`{point}`") >= F.col(f"span.`{low}`")) & (F.col(f"point.`{point}`") < F.col(f"span.`{high}`"))
    return met.where(inside).select("point.*", "span.*")


@query(
    "j13_range",
    "SELECT p.p_partkey, s.s_suppkey FROM part p JOIN supplier s ON p.p_retailprice >= s.s_acctbal AND p.p_retailprice < s.s_acctbal + 25",
)
def price_range(spark, sf_dir):
    spans = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 25).alias("high"))
    return range_join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), spans, "p_retailprice", "low", "high", 50.0).select("p_partkey", "s_suppkey")
