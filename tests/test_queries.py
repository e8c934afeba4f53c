"""Every registered query against its oracle, on the smallest tables."""

import glob
import os
import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis.strategies import data, integers, lists, none, tuples
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.registry import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_oracle(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    own = rows([tuple(r) for r in frame.collect()], frame.columns)
    if name in registry.oracles():
        found = duck.execute(registry.oracles()[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(frame.columns)
        assert own == rows(found.fetchall(), columns)


def test_posexplode_gives_every_element(spark, duck):
    found = registry.queries()["p3_posexplode"](spark, SF).count()
    assert found == duck.execute("select sum(len(embedding)) from embeddings").fetchone()[0] > 0


def test_cosine_search_asks_every_fiftieth_row(spark, duck):
    found = registry.queries()["f13_cosine"](spark, SF)
    asked = duck.execute("select count(*) from embeddings where vec_id % 50 = 0").fetchone()[0]
    assert asked > 1 and (found.count(), found.select("query_id").distinct().count()) == (10 * asked, asked)


def test_nearest_against_a_loop(spark):
    import numpy as np

    from lodestone.functions.vectors import nearest

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(60)] + [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0]), (104, rows_of_zero := [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and v and None not in v and any(v)}
    want = set()
    for q in list(unit)[::5]:
        near = sorted((-(round(float(unit[q] @ v), 4) + 0.0), i) for i, v in unit.items())[:4]
        want |= {(q, i, -c + 0.0) for c, i in near}
    asked = frame.where(f"vec_id in ({','.join(map(str, list(unit)[::5]))}) or vec_id >= 100 and vec_id < 104")
    for block in (10_000, 3):
        assert {tuple(r) for r in nearest(frame, asked, 4, block).collect()} == want
    assert nearest(frame, asked.limit(0), 4).count() == nearest(frame.limit(0), asked, 4).count() == 0 and rows_of_zero


def _loop(rows, asked, most):
    """The same answer from all pairs."""
    import numpy as np

    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [(i, v / np.linalg.norm(v)) for i, v in good]
    out = []
    for q in asked:
        for i, c in sorted(((i, round(float(u @ v), 4) + 0.0) for k, u in good if k == q for i, v in good if len(u) == len(v)), key=lambda x: (-x[1], x[0]))[:most]:
            out.append((q, i, c))
    return sorted(out)


def _vectors():
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [(int(i) - 30, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(70)]
    rows += [(2**62, [1.0, 1.0, 0.0, 0.0]), (-(2**63), [0.5, 0.5, 0.0, 0.0]), (101, [1.0, 2.0]), (102, [2.0, 1.0]), (103, [1.0] * 7), (104, None), (105, []), (106, [0.0] * 4), (107, [1.0, None, 0.0, 2.0])]
    return [*rows, (108, [float("nan")] * 4), (109, [float("inf"), 0.0, 0.0, 1.0]), (None, [1.0, 0.0, 0.0, 0.0]), (5, [1.0, 1.0, 0.0, 1.0])]


@pytest.mark.parametrize("asked", [[-30, -3, 0, 4], [101, 103, -7], [2**62, -(2**63), 104, 106, 108], [3]])
@pytest.mark.parametrize("index", [False, True])
def test_vectors_of_several_lengths_and_any_id(spark, asked, index):
    """One longer row or query among others loses nothing."""
    from lodestone.functions.vectors import Index, nearest

    rows = _vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    some = frame.where(f"vec_id in ({', '.join(map(str, asked))})".replace(str(-(2**63)), f"{-(2**63) + 1} - 1"))
    for block in (10_000, 2):
        found = Index(frame, lists=5, sample=30).nearest(some, 6, 2, block=block) if index else nearest(frame, some, 6, block)
        assert sorted(tuple(r) for r in found.collect()) == _loop(rows, asked, 6)


def test_inverted_file_probing_few_lists(spark):
    """Recall of the 10 nearest when few lists are probed, and no loss when the others are held against their bounds."""
    from lodestone.functions.vectors import Index, nearest

    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    asked = rows.where("vec_id % 50 = 0")
    exact = {tuple(r)[:2] for r in nearest(rows, asked).collect()}
    index = Index(rows)
    assert index.rows.count() == rows.count() and index.rows.select("list").distinct().count() > 8
    some = {tuple(r)[:2] for r in index.nearest(asked, exact=False).collect()}
    assert {tuple(r)[:2] for r in index.nearest(asked).collect()} == exact and len(some & exact) >= 0.9 * len(exact)


def test_index_of_equal_and_of_no_vectors(spark):
    from lodestone.functions.vectors import Index

    same = spark.range(3_000).selectExpr("id AS vec_id", "array(1f, 2f) AS embedding")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    index = Index(same, lists=4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.vec_id for r in index.nearest(same.where("vec_id = 7"), 3).orderBy("vec_id").collect()] == [0, 1, 2]
    parts = index.rows.select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert parts.agg(F.max("count")).first()[0] < 3_000, "a list of many rows is spread"
    assert Index(same.limit(0)).nearest(same.limit(5)).count() == Index(same).nearest(same.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["left", "right", "full"])
def test_outer_joins_of_whole_tables(spark, duck, kind):
    found = registry.queries()[f"j4_{kind}"](spark, SF)
    bare = duck.execute("select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)").fetchone()[0]
    lines = duck.execute("select count(*) from lineitem").fetchone()[0]
    assert bare > 0 and (found.where("lk is null").count(), found.count()) == (bare, lines + bare)


@pytest.mark.parametrize("name, node", [("u2_udaf", "AggregateInPandas|ArrowAggregatePython"), ("u2_udaf_window", "WindowInPandas|ArrowWindowPython")])
def test_udaf_is_user_defined(spark, name, node):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(node, plan)


def test_as_of_against_a_loop(spark):
    from lodestone.operators.joins import as_of

    left = [(1, 5, 0), (1, 1, 1), (2, 9, 2), (3, 4, 3), (None, 4, 4)]
    right = [(1, 5, 10), (1, 5, 11), (1, 2, 12), (2, 10, 13), (None, 1, 14), (3, None, 15)]
    met = as_of(spark.createDataFrame(left, "k long, t long, id long"), spark.createDataFrame(right, "k long, u long, rid long"), "k", "t", "u", "rid")
    want = {i: max(((u, r) for k2, u, r in right if k2 is not None and k2 == k and u is not None and u <= t), default=(None, None))[1] for k, t, i in left}
    assert {r.id: r.rid for r in met.collect()} == want


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data())
def test_as_of_of_drawn_rows(spark, drawn):
    from lodestone.operators.joins import as_of

    few = integers(0, 3)
    left = drawn.draw(lists(tuples(none() | few, none() | few), max_size=12))
    right = drawn.draw(lists(tuples(none() | few, none() | few, integers(0, 9)), max_size=12))
    rows = [(k, t, i) for i, (k, t) in enumerate(left)]
    met = as_of(spark.createDataFrame(rows, "k long, t long, i long"), spark.createDataFrame(right, "k long, u long, r long"), "k", "t", "u", "r")
    best = lambda k, t: max(((u, r) for o, u, r in right if None not in (k, t, o, u) and o == k and u <= t), default=(None, None))[1]
    assert sorted(((r.i, r.r) for r in met.collect()), key=repr) == sorted(((i, best(k, t)) for k, t, i in rows), key=repr)


def test_as_of_and_range_join_with_clashing_names(spark):
    from lodestone.operators.joins import as_of, range_join

    left = spark.createDataFrame([(1, 5, 0, 9), (None, 4, 1, 9), (2, None, 2, 9)], "k long, t long, met long, side long")
    right = spark.createDataFrame([(1, 3, 7), (None, 1, 8), (2, 1, None)], "k long, u long, rid long")
    assert {tuple(r) for r in as_of(left, right, "k", "t", "u", "rid").collect()} == {(1, 5, 0, 9, 7), (None, 4, 1, 9, None), (2, None, 2, 9, None)}
    points = spark.createDataFrame([(0.5, 1), (None, 2), (99.0, 3)], "p double, bucket long")
    spans = spark.createDataFrame([(0.0, 50.0, "a"), (0.5, 0.5, "none"), (None, 3.0, "x"), (90.0, 120.0, "b")], "low double, high double, point string")
    met = range_join(points, spans, "p", "low", "high", 10.0)
    assert met.columns == ["p", "bucket", "low", "high", "point"] and {(r.bucket, r.point) for r in met.collect()} == {(1, "a"), (3, "b")}


@pytest.mark.parametrize("width", [0.5, 10.0, 1e6])
def test_range_join_of_drawn_spans(spark, width):
    """Spans of all widths, the whole domain, infinite and NaN bounds."""
    import random

    from lodestone.operators.joins import range_join

    rng, nan, inf = random.Random(3), float("nan"), float("inf")
    points = [(i, rng.choice([rng.uniform(-50, 50), rng.uniform(-1e9, 1e9), float(rng.randint(-8, 8))])) for i in range(150)] + [(900, None), (901, nan), (902, inf), (903, -inf), (904, 1e300), (905, -0.0)]
    spans = [(i, low, low + rng.choice([0.0, 0.25, 1.0, 8.0, 60.0, 5e8, -1.0])) for i, low in enumerate([float(rng.randint(-60, 60)) for _ in range(80)])]
    spans += [(900, -inf, inf), (901, -1e12, 1e12), (902, nan, 3.0), (903, None, 3.0), (904, 0.0, nan), (905, 0.0, inf), (906, -1e300, 1e301), (907, 4.0, None), (908, 0.1 + 0.2, 0.3 + 4)]
    frame = spark.createDataFrame(spans, "sid long, low double, high double")
    met = range_join(spark.createDataFrame(points, "pid long, p double"), frame, "p", "low", "high", width)
    good = [(s, a, b) for s, a, b in spans if a is not None and b is not None and a < b]
    assert sorted((r.pid, r.sid) for r in met.collect()) == sorted((i, s) for i, p in points if p is not None and p == p for s, a, b in good if a <= p < b)
    whole = spark.createDataFrame([(1, -1e15, 1e15)] * 3, "sid long, low double, high double")
    plan = range_join(spark.range(5).selectExpr("id", "id + 0.5D AS p"), whole, "p", "low", "high", 1e-3)
    assert plan.count() == 15


def test_not_in_with_a_null(spark):
    spark.createDataFrame([(1,), (None,)], "x int").createOrReplaceTempView("some_and_null")
    assert spark.sql("SELECT * FROM VALUES (1), (2) AS t(x) WHERE x NOT IN (SELECT x FROM some_and_null)").count() == 0
    assert spark.sql("SELECT * FROM VALUES (1), (2) AS t(x) WHERE x NOT IN (SELECT x FROM some_and_null WHERE x IS NOT NULL)").count() == 1


@pytest.mark.parametrize(
    "sql, want",
    [
        ("sum(cast(x AS decimal(10, 2))) FROM VALUES (1.25), (2.50), (null) AS t(x)", "3.75"),
        ("max(x) = double('NaN') FROM VALUES (double('NaN')), (1.0D) AS t(x)", "True"),
        ("count(DISTINCT x) FROM VALUES (double('NaN')), (double('NaN')), (0.0D), (-0.0D) AS t(x)", "2"),
        ("map('a', 1, 'b', null)['b'] IS NULL", "True"),
        ("named_struct('a', 1, 'b', 'x').b", "x"),
        ("INTERVAL '1 2' DAY TO HOUR + INTERVAL '3' HOUR = INTERVAL '1 5' DAY TO HOUR", "True"),
        ("sum(x) IS NULL FROM VALUES (cast(null AS int)) AS t(x)", "True"),
        ("size(array()) + coalesce(size(null), 0)", "0"),
        ("to_json(named_struct('a', cast(null AS int), 'b', date '2024-02-29'))", '{"b":"2024-02-29"}'),
        ("cast(x'616263' AS string) || hex(x'00ff')", "abc00FF"),
    ],
)
def test_types_that_no_table_has(spark, sql, want):
    assert str(spark.sql(f"SELECT {sql}").first()[0]) == want


def test_pushdown_reaches_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = registry.queries()["s2_pushdown"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,45.0)" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_late_rows_are_dropped(spark, tmp_path):
    """A row older than the previous batch's watermark doesn't reach its window."""
    from lodestone.streaming.events import tumbling

    for i, times in enumerate((["01:10"], ["05:00"], ["06:00"], ["01:20", "07:00"], ["12:00"])):
        spark.createDataFrame([(f"2024-01-01 {t}:00",) for t in times], "s string").selectExpr("cast(s as timestamp) ts").coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    source = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    run = tumbling(source).writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    run.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in run.recentProgress for s in p["stateOperators"])
    first = spark.table("late").where("start = timestamp_ntz '2024-01-01 01:00:00'").collect()
    assert dropped == 1 and [r.n for r in first] == [1]


def test_streams_over_several_micro_batches(spark):
    """Timers, repeats and joins meet rows of earlier micro-batches; the numbers of batches and of dropped rows are Spark's own."""
    from lodestone.shared import written
    from lodestone.ship import ship
    from lodestone.streaming import events

    ship(spark)
    made = [(i, f"2024-01-01 {t}", 1 + i % 2, kind) for i, (t, kind) in enumerate([("00:00:00", "click"), ("00:01:00", "click"), ("00:10:00.5", "view"), ("00:25:00", "click"), ("03:00:00", "view"), ("06:00:00", "click"), ("09:00:00", "click"), ("12:00:00", "view")])]
    rows = spark.createDataFrame(made, "event_id long, s string, user_id long, event_type string").selectExpr("event_id", "cast(s AS timestamp_ntz) AS ts", "user_id", "event_type", "1.0D AS value", "'' AS props")
    folder = written(rows.coalesce(1)).inputFiles()[0].rsplit("/", 1)[0]
    root = f"{folder}-tables"
    spark.read.parquet(folder).write.parquet(f"{root}/events.parquet")
    late = rows.where("event_id = 1").withColumn("ts", F.col("ts").cast("timestamp"))
    said: list = []
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    with events.conf(spark, spark__sql__streaming__stateStore__providerClass=store):
        found = events.drained(events.visits(events.parted(spark, root, 5, late)), progress=said)
    got = sorted((r.user_id, str(r.start)[11:16], r.n, r.clicks, r.nth) for r in found.collect())
    assert got == [(1, "00:00", 2, 1, 1), (1, "03:00", 1, 0, 2), (1, "09:00", 1, 1, 3), (2, "00:01", 2, 2, 1), (2, "06:00", 1, 1, 2)]
    assert sum(p["numInputRows"] > 0 for p in said) >= 5 and sum(s["numRowsDroppedByWatermark"] for p in said for s in p["stateOperators"]) == 1
    said = []
    again = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    once = events.drained(events.once(events.parted(spark, root, 5, again)), progress=said)
    assert sorted(r.event_id for r in once.collect()) == list(range(8)) and sum(p["numInputRows"] for p in said) == 16
    said = []
    spark.read.parquet(folder).where("event_id < 3").write.parquet(f"{root}-few/events.parquet")
    met = events.drained(events.soon_after(events.parted(spark, f"{root}-few", 4)), progress=said)
    assert [tuple(r) for r in met.collect()] == [(0, 2)] and sum(p["numInputRows"] > 0 for p in said) == 2


def events_of_several_files(spark, files=4):
    """A folder of tables whose events are in several files, each with times of all days."""
    from lodestone.shared import shared_folder

    root = shared_folder(spark)
    made = spark.range(400).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 40 * ((id * 37) % 400)) AS ts", "id % 150 AS user_id", "if(id % 3 = 0, 'click', 'view') AS event_type", "1.0D AS value", "'' AS props")
    made.repartition(files).write.parquet(f"{root}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{root.removeprefix('file://')}/events.parquet/*.parquet'")
    return root, con


def equal_to_sql(spark, name, root, con):
    frame = registry.queries()[name](spark, root)
    found = con.execute(registry.oracles()[name])
    want = rows(found.fetchall(), [c[0] for c in found.description])
    return len(want) > 1 and rows([tuple(r) for r in frame.collect()], frame.columns) == want


@pytest.mark.parametrize("name", ["t11_late", "t7_repeats"])
def test_a_part_of_several_files_is_one_micro_batch(spark, name):
    root, con = events_of_several_files(spark)
    assert equal_to_sql(spark, name, root, con)


def test_visits_of_users_are_kept_by_block_in_a_micro_batch_a_part(spark):
    from lodestone.ship import ship
    from lodestone.streaming import events

    root, con = events_of_several_files(spark)
    assert equal_to_sql(spark, "t10_timers", root, con)
    ship(spark)
    said: list = []
    with events.conf(spark, spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        events.drained(events.visits(events.parted(spark, root)), progress=said)
    assert sum(p["numInputRows"] > 0 for p in said) == events.PARTS
    # 150 users in three blocks, each with one timer
    assert 0 < sum(s["customMetrics"]["numRegisteredTimers"] for p in said for s in p["stateOperators"]) <= 3 * 2 * (events.PARTS + 1)


def test_counts_of_users_are_kept_by_block_in_a_micro_batch_a_part(spark):
    root, con = events_of_several_files(spark)
    assert equal_to_sql(spark, "t10_state", root, con)
    from lodestone.ship import ship
    from lodestone.streaming import events

    ship(spark)
    said: list = []
    with events.conf(spark, spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        counted = events.in_blocks(events.parted(spark, root).select("user_id")).transformWithStateInPandas(statefulProcessor=events.Counts(), outputStructType="user_id bigint, n bigint", outputMode="update", timeMode="none")
        events.drained(counted, "update", said)
    assert sum(p["numInputRows"] > 0 for p in said) == events.PARTS


def test_not_in_needs_no_broadcast_of_the_column(spark):
    from lodestone.operators.joins import not_in

    for have in ([], [1, 3], [1, None], [None]):
        left, right = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int"), spark.createDataFrame([(v,) for v in have], "y int")
        left.createOrReplaceTempView("not_in_left"), right.createOrReplaceTempView("not_in_right")
        want = spark.sql("SELECT x FROM not_in_left WHERE x NOT IN (SELECT y FROM not_in_right)").collect()
        assert sorted(map(str, not_in(left, "x", right, "y").collect())) == sorted(map(str, want))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = registry.queries()["j7_not_in"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_recursion_is_not_limited_in_rows(spark):
    from lodestone.shared import conf

    # the walk has more rows than this
    with conf(spark, spark__sql__cteRecursionRowLimit="100"):
        assert registry.queries()["p7_recursive"](spark, SF).count() > 100
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "100"


def test_sketches_are_made_by_flag_only(spark):
    """No sketch is made for each flag and part, as beside an exact distinct count."""
    plan = registry.queries()["a8_sketches"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    made = [line for line in plan.split("\n") if "theta_sketch_agg" in line and "Aggregate(" in line]
    assert made and not any("keys=[l_returnflag#" in line and "l_partkey#" in line.split("functions=")[0] for line in made)


@pytest.mark.parametrize("name", ["u4_grouped_pandas", "u4_grouped_arrow"])
def test_grouped_maps_get_a_block_of_keys(spark, name):
    from lodestone.operators.udfs import KEYS
    from lodestone.shared import shared_folder

    root = shared_folder(spark)
    made = [(None if i % 7 == 0 else (i % 5) * KEYS // 2 - KEYS, i, None if i % 4 == 0 else i * 1.25) for i in range(60)] + [(9, 99, None)]
    spark.createDataFrame(made, "o_custkey long, o_orderkey long, o_totalprice double").write.parquet(f"{root}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{root.removeprefix('file://')}/orders.parquet/*.parquet'")
    assert equal_to_sql(spark, name, root, con)
    assert "block" in registry.queries()[name](spark, root)._jdf.queryExecution().executedPlan().toString()


def test_cogroup_gets_a_block_of_keys(spark):
    from lodestone.operators.udfs import KEYS
    from lodestone.shared import shared_folder

    root, con = shared_folder(spark), duckdb.connect()
    keys = [None, -3, 0, 1, KEYS - 1, KEYS, 5 * KEYS, 2**60 + 1]
    for name, schema, made in (
        ("customer", "c_custkey long", [(k,) for k in keys]),
        ("orders", "o_custkey long", [(k,) for k in [None, -3, 0, 0, KEYS, 2**60 + 1, 2**60 + 2]]),
        ("events", "user_id long", [(k,) for k in [None, 0, 1, 1, 7 * KEYS, 2**60 + 1]]),
    ):
        spark.createDataFrame(made, schema).write.parquet(f"{root}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{root.removeprefix('file://')}/{name}.parquet/*.parquet'")
    assert equal_to_sql(spark, "u4_cogroup", root, con)
    assert "block" in registry.queries()["u4_cogroup"](spark, root)._jdf.queryExecution().executedPlan().toString()


def test_only_hot_keys_are_aggregated_in_parts(spark, monkeypatch):
    from lodestone.operators import udfs
    from lodestone.shared import shared_folder

    root, con = shared_folder(spark), duckdb.connect()
    monkeypatch.setattr(udfs, "PART", 50)
    made = spark.range(1_000).selectExpr("id AS event_id", "if(id < 300, 1, if(id < 400, null, id div 20)) AS user_id", "cast((id * 37) % 1000 AS double) AS value")
    made.write.parquet(f"{root}/events.parquet")
    con.execute(f"create view events as select * from '{root.removeprefix('file://')}/events.parquet/*.parquet'")
    assert equal_to_sql(spark, "u2_udaf", root, con)
    assert "splits" in registry.queries()["u2_udaf"](spark, root)._jdf.queryExecution().executedPlan().toString()
