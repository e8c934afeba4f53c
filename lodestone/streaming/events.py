"""Event-time streaming: S8, T1-T11. Event times of type timestamp_ntz are cast, as watermarks need timestamp."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..registry import query, table
from ..shared import conf
from ..sources.formats import shared_folder


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a file stream with ts as timestamp."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


#: Parts of equal spans of time in which events come to the streams that are to run over several micro-batches.
PARTS = 5


def staged(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame:
    """The parts, of one schema, as a stream that has one micro-batch for each, in order. A micro-batch takes a fixed number of files, the oldest ones,
    so each part is written by that many tasks; where some had no rows, files without rows make up the number."""
    root, files = shared_folder(spark), spark.sparkContext.defaultParallelism
    path = spark._jvm.org.apache.hadoop.fs.Path
    system, settings, blank = path(root).getFileSystem(spark._jsc.hadoopConfiguration()), spark._jsc.hadoopConfiguration(), None
    for number, rows in enumerate(parts):
        folder = f"{root}/in/{number}"
        rows.repartition(files).write.parquet(folder)
        found = [x.getPath() for x in system.listStatus(path(folder)) if x.getPath().getName().startswith("part-")]
        if len(found) < files and blank is None:
            rows.limit(0).coalesce(1).write.parquet(f"{root}/blank")
            (blank,) = [x.getPath() for x in system.listStatus(path(f"{root}/blank")) if x.getPath().getName().startswith("part-")]
        for more in range(len(found), files):
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(system, blank, system, path(f"{folder}/part-more-{more}.parquet"), False, settings)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(f"{root}/in")


def parted(spark: SparkSession, sf_dir: str, parts: int = PARTS, *more: DataFrame) -> DataFrame:
    """events as a stream of one micro-batch after another: one for each part of their time, in order, then those of more."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    low, high = events.agg(F.min(at), F.max(at)).first()
    part = F.least((at - F.lit(low)) * parts / F.lit(max(1, (high or 0) - (low or 0))), F.lit(parts - 1)).cast("int")
    return staged(spark, (rows.select(*events.columns) for rows in (*(events.where(part == n) for n in range(parts)), *more)))


def drained(frame: DataFrame, mode: str = "append", progress: list | None = None) -> DataFrame:
    """The rows that a stream gives until its input ends, as Parquet in the shared folder. Each micro-batch has a folder of its
    own, which a repeated one writes anew; in complete mode the last one holds all. progress gets what Spark says of each micro-batch."""
    spark = frame.sparkSession
    root, last = shared_folder(spark), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/{number}")
        last[:] = [number]

    run = frame.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    if progress is not None:
        progress += run.recentProgress
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in frame.schema])
    if not last:
        return spark.createDataFrame([], schema)
    path = f"{root}/rows/{last[0]}" if mode == "complete" else f"{root}/rows"
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def tumbling(frame: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    return frame.withWatermark("ts", late).groupBy(F.window("ts", size)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def sliding(frame: DataFrame, late: str = "10 minutes", size: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    return frame.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(frame: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    return frame.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), "n")


def once(frame: DataFrame, late: str = "10 minutes") -> DataFrame:
    return frame.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")


def soon_after(frame: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Clicks and a view of the same user in the quarter of an hour after each: a stream-stream interval join."""
    click, view = (frame.where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{kind}_id"), F.col("user_id").alias(f"{kind}_user"), F.col("ts").alias(f"{kind}_ts")).withWatermark(f"{kind}_ts", late) for kind in ("click", "view"))
    near = F.expr("click_user = view_user AND view_ts >= click_ts AND view_ts < click_ts + INTERVAL 15 MINUTES")
    return click.join(view, near).select("click_id", "view_id")


def with_segment(frame: DataFrame, customer: DataFrame) -> DataFrame:
    return frame.join(customer, F.col("user_id") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


#: Windows that the last watermark has closed: it stands ten minutes before the last event.
_CLOSED = "WHERE e <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def _query(name: str, oracle: str | None, mode: str = "append") -> Callable:
    def add(plan: Callable[[DataFrame, SparkSession, str], DataFrame]) -> None:
        query(name, oracle)(lambda spark, sf_dir: drained(plan(stream(spark, sf_dir), spark, sf_dir), mode))

    return add


_query("t2_tumbling", f"SELECT start, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS e, count(*) AS n FROM events GROUP BY ALL) {_CLOSED}")(lambda s, *_: tumbling(s))
_query("t3_complete", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL", "complete")(lambda s, *_: tumbling(s))
_query("t4_sliding", f"SELECT start, n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS start, time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE + INTERVAL 1 HOUR AS e, count(*) AS n FROM events, range(0, 4) r(i) GROUP BY ALL) {_CLOSED}")(lambda s, *_: sliding(s))
_query(
    "t5_sessions",
    "WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m) "
    f"SELECT user_id, start, n FROM (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS e, count(*) AS n FROM g GROUP BY user_id, s) {_CLOSED}",
)(lambda s, *_: sessions(s))
_query("t7_dedup", "SELECT event_id, event_type FROM events")(lambda s, *_: once(s.union(s)))
_query("t8_interval_join", "SELECT c.event_id AS click_id, v.event_id AS view_id FROM events c JOIN events v ON c.user_id = v.user_id AND c.event_type = 'click' AND v.event_type = 'view' AND v.ts >= c.ts AND v.ts < c.ts + INTERVAL 15 MINUTE")(lambda s, *_: soon_after(s))
_query("t9_static_join", "SELECT c_mktsegment, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY 1", "complete")(lambda s, spark, sf: with_segment(s, table(spark, sf, "customer").select("c_custkey", "c_mktsegment")))


#: Users whose state has one key: every access to state is a message to Spark and back, and so is shared by many.
BLOCK = 64


def _users(key: tuple, part) -> list:
    """The users of a part; the users of block null are null."""
    return [None] * len(part) if key[0] is None else part["user_id"].tolist()


class Counts(StatefulProcessor):
    """A count for each user, kept across the micro-batches of a stream, in a list for each block of users."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getListState("counts", "user_id bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        counts, come = dict(self.counts.get()), Counter()
        for part in rows:
            come.update(_users(key, part))
        for user, n in come.items():
            counts[user] = counts.get(user, 0) + n
        self.counts.put(list(counts.items()))
        yield pd.DataFrame({"user_id": list(come), "n": [counts[user] for user in come]})


class Visits(StatefulProcessor):
    """The visits of a block of users: a user's events with less than `gap` between them. A list holds user, first time, last time, events and
    clicks of each open visit, in order, a map how many visits each user has had. One timer on event time is set for when the watermark has
    passed the first visit to end by the gap; then all visits that it has passed are given out and their state is gone. Rows may come in any order
    within the watermark: an event between two open visits makes them one."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "user_id bigint, first bigint, last bigint, n bigint, clicks bigint")
        self.visits = handle.getMapState("visits", "user_id bigint", "n bigint")

    def _due(self, visit: tuple) -> int:
        """When a visit is over; a timer has milliseconds: rounded up, so that none is early."""
        return -(-visit[2] // 1_000) + self.gap

    def _joined(self, spans: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for user, first, last, n, clicks in sorted(spans):
            if out and out[-1][0] == user and first < out[-1][2] + self.gap * 1_000:
                _, start, end, had, clicked = out[-1]
                out[-1] = (user, start, max(end, last), had + n, clicked + clicks)
            else:
                out.append((user, first, last, n, clicks))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        before = [tuple(v) for v in self.open.get()]
        visits = before
        for part in rows:
            visits = self._joined(visits + [(user, at, at, 1, int(click)) for user, at, click in zip(_users(key, part), part["at"].tolist(), part["click"].tolist())])
        self.open.put(visits)
        had, due = min(map(self._due, before), default=None), min(map(self._due, visits))
        if had != due:
            if had is not None:
                self.handle.deleteTimer(had)
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        visits = [tuple(v) for v in self.open.get()]
        over, left = [v for v in visits if self._due(v) <= due], [v for v in visits if self._due(v) > due]
        before = {user: n for (user,), (n,) in self.visits.iterator()}
        had, rows = dict(before), []
        for user, first, _, n, clicks in over:
            had[user] = had.get(user, 0) + 1
            rows.append((user, first, n, clicks, had[user]))
        for user, n in had.items():
            if before.get(user) != n:
                self.visits.updateValue((user,), (n,))
        if left:
            self.open.put(left)
            self.handle.registerTimer(min(map(self._due, left)))
        else:
            self.open.clear()
        yield pd.DataFrame(rows, columns=["user_id", "start", "n", "clicks", "nth"])


def in_blocks(frame: DataFrame) -> GroupedData:
    return frame.withColumn("block", F.expr(f"user_id div {BLOCK}")).groupBy("block")


def visits(frame: DataFrame, late: str = "10 minutes", gap_ms: int = 1_800_000) -> DataFrame:
    """user_id, start, n, clicks and nth (which of the user's visits it is) of each visit that is over."""
    rows = frame.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce(F.col("event_type") == "click", F.lit(False)).alias("click"))
    found = in_blocks(rows).transformWithStateInPandas(statefulProcessor=Visits(gap_ms), outputStructType="user_id bigint, start bigint, n bigint, clicks bigint, nth bigint", outputMode="append", timeMode="eventTime")
    return found.withColumn("start", F.timestamp_micros("start").cast("timestamp_ntz"))


@query("t10_state", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def running_counts(spark, sf_dir):
    """Arbitrary state in a RocksDB store: a count per user, kept across several micro-batches; the last one of each user."""
    from ..ship import ship

    ship(spark)
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    with conf(spark, spark__sql__streaming__stateStore__providerClass=store):
        counted = in_blocks(parted(spark, sf_dir).select("user_id")).transformWithStateInPandas(statefulProcessor=Counts(), outputStructType="user_id bigint, n bigint", outputMode="update", timeMode="none")
        return drained(counted, "update").groupBy("user_id").agg(F.max("n").alias("n"))


@query(
    "t10_timers",
    "WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m) "
    f"SELECT user_id, start, n, clicks FROM (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS e, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM g GROUP BY user_id, s) {_CLOSED}",
)
def timed_visits(spark, sf_dir):
    """Visits by list and map state and event-time timers, over several micro-batches; the same as sessions by window."""
    from ..ship import ship

    ship(spark)
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    with conf(spark, spark__sql__streaming__stateStore__providerClass=store):
        return drained(visits(parted(spark, sf_dir))).select("user_id", "start", "n", "clicks")


@query("t7_repeats", "SELECT event_id, event_type FROM events")
def repeats_over_batches(spark, sf_dir):
    """Each part of the events comes, and then all events again: copies that come in another micro-batch than the first are dropped, as long as the
    watermark lets them in, and are behind it later."""
    again = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return drained(once(parted(spark, sf_dir, PARTS, again)))


@query("t8_join_over_batches", "SELECT c.event_id AS click_id, v.event_id AS view_id FROM events c JOIN events v ON c.user_id = v.user_id AND c.event_type = 'click' AND v.event_type = 'view' AND v.ts >= c.ts AND v.ts < c.ts + INTERVAL 15 MINUTE")
def join_over_batches(spark, sf_dir):
    """The interval join where a click and its view may come in different micro-batches: clicks wait in the state."""
    return drained(soon_after(parted(spark, sf_dir)))


def refused(start: Callable[[], object], condition: str) -> bool:
    """Whether start() fails with an analysis error of this condition."""
    try:
        start()
    except AnalysisException as error:
        return condition in f"{error.getCondition()} {error}"
    return False


@query("t1_watermark", "SELECT true AS refused, count(*) AS n FROM events")
def watermark(spark, sf_dir):
    """A watermark wants a timestamp: one on timestamp_ntz is refused; the cast column has one and keeps rows in order."""
    plain = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    said = refused(lambda: drained(plain.withWatermark("ts", "10 minutes").select("event_id")), "EVENT_TIME_IS_NOT_ON_TIMESTAMP_TYPE")
    kept = drained(stream(spark, sf_dir).withWatermark("ts", "10 minutes").select("event_id"))
    return kept.agg(F.lit(said).alias("refused"), F.count(F.lit(1)).alias("n"))


@query("t6_append_without_watermark", "SELECT true AS refused, count(DISTINCT user_id) AS n FROM events")
def append_without_watermark(spark, sf_dir):
    """An aggregation in append mode without a watermark is refused; in complete mode it gives all groups."""
    counted = stream(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    said = refused(lambda: drained(counted), "STREAMING_OUTPUT_MODE")
    return drained(counted, "complete").agg(F.lit(said).alias("refused"), F.count(F.lit(1)).alias("n"))


@query("t11_late", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def late(spark, sf_dir):
    """All events, then twice one row days later, then all events again: the second time they are behind the watermark and
    dropped, so each window has its events once. The row from days later is in no closed window."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    end = events.agg(F.max("ts").alias("ts"))
    source = staged(spark, (events, end.selectExpr("ts + INTERVAL 2 DAYS AS ts"), end.selectExpr("ts + INTERVAL 3 DAYS AS ts"), events))
    return drained(tumbling(source)).where(F.col("start") <= end.select(F.col("ts").cast("timestamp_ntz")).first()[0])
