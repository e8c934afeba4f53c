"""Order statistics and as-of joins of hot keys against plain versions, in more tasks than keys."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators.joins import as_of
from lodestone.operators.ranked import numbered, quantiles, tile


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("falling", [False, True])
@pytest.mark.parametrize("values", [3, 400])
def test_numbers_ranks_and_tiles(spark, many_parts, falling, values):
    """With 3 values runs of ties reach over several parts."""
    rng = random.Random(values)
    rows = [(i, "hot" if rng.random() < 0.9 else rng.choice(["a", None]), rng.choice([None, *range(values)])) for i in range(1_500)]
    frame = spark.createDataFrame(rows, "id long, k string, v int").withColumn("rank", F.lit("own"))
    found = numbered(frame, "k", ["v", "id"], falling)
    assert found.columns == ["id", "k", "v", "number", "rank", "of"]
    got = {r.id: (r.number, r.rank, r.of, r.t) for r in found.withColumn("t", tile(7)).collect()}
    place = lambda r: (r[2] is None) if falling else (r[2] is not None)
    for key in ("hot", "a", None):
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (place(r), -(r[2] or 0), -r[0]) if falling else (place(r), r[2] or 0, r[0]))
        size, more = divmod(len(own), 7)
        tiles = [t for t in range(1, 8) for _ in range(size + (t <= more))]
        first = {}
        for i, r in enumerate(own, 1):
            first.setdefault(r[2], i)
            assert got[r[0]] == (i, first[r[2]], len(own), tiles[i - 1])
    assert numbered(frame.limit(0), "k", ["v", "id"]).count() == 0


def test_a_hot_key_has_many_tasks(spark, many_parts):
    frame = spark.range(5_000).selectExpr("id", "'k' AS k", "id % 2 AS v")
    rows = numbered(frame, "k", ["v", "id"])
    assert rows.agg(F.max("number"), F.sum("rank")).first() == (5_000, 2_500 * 1 + 2_500 * 2_501)
    from lodestone.shared import written

    parts = written(frame.repartitionByRange("k", "v", "id").withColumn("p", F.spark_partition_id())).groupBy("p").count()
    assert parts.count() > 1 and parts.agg(F.max("count")).first()[0] < 5_000


@pytest.mark.parametrize("bars, left", [(1_024, 10_000), (4, 3), (2, 1)])
def test_quantiles(spark, bars, left):
    rng = np.random.default_rng(5)
    by = {"wide": list(np.exp(rng.normal(0, 30, 300))), "ties": [1.0] * 200 + [2.0] * 10, "one": [7.5], "near": list(1 + rng.integers(0, 50, 100) * 1e-12), "big": [-1.7e308, 1.7e308, 0.0, 1.0], None: [3.0, 4.0]}
    rows = [(k, float(v)) for k, vs in by.items() for v in vs] + [("ties", None), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    found = {(r.k, r.share): r.quantile for r in quantiles(frame, "k", "v", shares, bars, left).collect()}
    assert set(found) == {(k, s) for k in by for s in shares}
    for (k, s), q in found.items():
        own = sorted(by[k])
        at = s * (len(own) - 1)
        a, b = own[int(np.floor(at))], own[int(np.ceil(at))]
        assert q == (a if a == b else a + (b - a) * (at - np.floor(at))), (k, s)
    assert quantiles(frame.limit(0), "k", "v", shares).count() == 0


def test_quantiles_with_nan_and_infinity(spark):
    rows = [("a", float("nan")), ("a", 1.0), ("a", 2.0), ("b", float("nan")), ("c", float("inf")), ("c", float("-inf")), ("c", 0.0)]
    found = {(r.k, r.share): r.quantile for r in quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", [0.0, 0.5, 1.0]).collect()}
    assert found["a", 0.5] == 2.0 and np.isnan(found["a", 1.0]) and np.isnan(found["b", 0.0]) and found["c", 0.5] == 0.0 and found["c", 1.0] == 1.7976931348623157e308


TIMES = {"int": lambda x: x, "double": float, "timestamp": lambda x: datetime(2024, 3, 31) + timedelta(minutes=x), "timestamp_ntz": lambda x: datetime(2024, 3, 31) + timedelta(minutes=x), "date": lambda x: date(2024, 1, 1) + timedelta(days=x), "string": lambda x: f"{x:05d}"}


@pytest.mark.parametrize("kind", sorted(TIMES))
@pytest.mark.parametrize("blocks", [1_024, 5])
def test_as_of_with_a_hot_key(spark, kind, blocks):
    rng, time = random.Random(blocks), TIMES[kind]
    key = lambda: "hot" if rng.random() < 0.9 else rng.choice(["b", None])
    left = [(i, key(), rng.choice([None, *range(0, 300, 3)])) for i in range(400)]
    right = [(i, key(), rng.choice([None, *range(40, 260, 7)])) for i in range(60)]
    frames = [spark.createDataFrame([(i, k, None if t is None else time(t)) for i, k, t in rows], f"{name} long, k string, {name}_t {kind}").repartition(3) for rows, name in ((left, "l"), (right, "r"))]
    met = {row.l: row.r for row in as_of(*frames, "k", "l_t", "r_t", "r", blocks).collect()}
    assert met == {i: max(((u, r) for r, o, u in right if None not in (k, t, o, u) and o == k and u <= t), default=(None, None))[1] for i, k, t in left}


def test_as_of_with_nan_and_infinite_times(spark):
    nan, inf = float("nan"), float("inf")
    left = spark.createDataFrame([(1, nan), (2, inf), (3, -inf), (4, 5.0)], "id long, t double").withColumn("k", F.lit(1))
    right = spark.createDataFrame([(10, 4.0), (11, -inf), (12, 6.0), (13, nan)], "rid long, u double").withColumn("k", F.lit(1))
    assert {r.id: r.rid for r in as_of(left, right, "k", "t", "u", "rid").collect()} == {1: 13, 2: 12, 3: 11, 4: 10}


def test_as_of_deals_a_hot_key_by_time(spark, many_parts):
    left = spark.range(4_000).selectExpr("1 AS k", "id AS t", "id AS l")
    right = spark.range(0, 4_000, 50).selectExpr("1 AS k", "id AS u", "id AS r")
    met = as_of(left, right, "k", "t", "u", "r", 64)
    assert met.where("r = t - t % 50").count() == 4_000
    tasks = met.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(t["count"] > 0 for t in tasks) > 1 and max(t["count"] for t in tasks) < 4_000
