"""Registered streaming queries: each processes the event files that are there and returns the sink's rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.scratch import new_path
from lakeloom.sources.tables import read_table
from lakeloom.streaming import events

from .registry import register


def _events(spark: SparkSession, sf: str) -> DataFrame:
    # A pattern, since the file source takes a folder or a pattern but no single file.
    path = f"{sf}/events*.parquet"
    # Files of one table may overlap in time: the delay is what they do.
    return events.read_events(spark, path, delay=_delay(spark, path))


def _delay(spark: SparkSession, path: str) -> str:
    return f"{math.ceil(events.disorder(spark, path)) + 1} seconds"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for a query's start."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _complete(stream: DataFrame) -> DataFrame:
    """The last full result of an aggregating stream."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession)
    keep = lambda df, _: df.write.mode("overwrite").parquet(path)
    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", new_path(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _append(stream: DataFrame) -> DataFrame:
    spark, path = stream.sparkSession, new_path(stream.sparkSession)
    events.run_once(stream, path, new_path(spark))
    return spark.read.schema(stream.schema).parquet(path)


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


@register("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_complete(events.tumbling(_events(spark, sf)).drop("total")))


@register("stream_sliding", "SELECT w AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY w")
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_complete(events.sliding(_events(spark, sf))))


@register("stream_enrich", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def stream_enrich(spark: SparkSession, sf: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    bought = _events(spark, sf).where("event_type = 'purchase'")
    return _append(bought.join(customers, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment"))


@register("stream_no_repeats", "SELECT event_id, event_type FROM events")
def stream_no_repeats(spark: SparkSession, sf: str) -> DataFrame:
    s = _events(spark, sf)
    return _append(events.without_repeats(s.unionByName(s), ["event_id"]).select("event_id", "event_type"))


@register("stream_follow_up", "SELECT a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_follow_up(spark: SparkSession, sf: str) -> DataFrame:
    s = lambda kind: _events(spark, sf).where(F.col("event_type") == kind)
    return _append(events.followed_by(s("click"), s("purchase"), "1 hour").select("first_id", "then_id"))


#: An event later than all others, so that append mode closes every window before it.
CLOSING = "2100-01-01 00:00:00"


#: Rows of a file of a week, about.
FILE_ROWS = 1_000_000


def _in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a batch of files for each week, oldest first, and a closing row in the last.

    The table is dealt out by weeks once, so that the work for a week is that
    on its own rows, in as many tasks as it has files.
    """
    staged, path = new_path(spark), new_path(spark)
    week = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (7 * 86400)).alias("week")
    table = read_table(spark, sf, "events").select("*", week).where("week IS NOT NULL")
    sizes = {r["week"]: r["count"] for r in table.groupBy("week").count().collect()}
    files = max(1, -(-max(sizes.values(), default=0) // FILE_ROWS))
    dealt = table.repartition(files * max(1, len(sizes)), "week", F.pmod(F.xxhash64("event_id"), F.lit(files)))
    dealt.write.partitionBy("week").parquet(staged)
    for w in sorted(sizes):
        rows = spark.read.schema(events.SCHEMA).parquet(f"{staged}/week={w}")
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(path)
    # Files of one week overlap; those of a week with fewer may share a batch with the next one's.
    delay = "1 hour" if files == 1 else _delay(spark, path)
    _close(spark, path)
    return events.read_events(spark, path, files, delay)


def _close(spark: SparkSession, path: str) -> None:
    spark.sql(f"SELECT -1L AS event_id, timestamp_ntz'{CLOSING}' AS ts, -1L AS user_id, 'end' AS event_type, 0D AS value, '' AS props").write.mode("append").parquet(path)


@register("stream_tumbling_append", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_append(spark: SparkSession, sf: str) -> DataFrame:
    """Append mode: a window comes out once, when the watermark has passed it."""
    return _plain(_append(events.tumbling(_in_order(spark, sf)).drop("total"))).where("event_type <> 'end'")


@register(
    "stream_sessions",
    "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(_append(events.session_counts(_in_order(spark, sf)).select("user_id", "start", "n"))).where("user_id >= 0")


@register("stream_running_counts", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_running_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed state: the last count of each user over all batches."""
    path = new_path(spark)
    keep = lambda df, _: df.write.mode("append").parquet(path)
    with _rocksdb(spark):
        stream = events.running_totals(_in_order(spark, sf))
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", new_path(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).where("user_id >= 0").groupBy("user_id").agg(F.max("n").alias("n"))


@register("stream_sliding_append", "SELECT w AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY w")
def stream_sliding_append(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping windows in append mode: each comes out once."""
    return _plain(_append(events.sliding(_in_order(spark, sf)))).where(f"start < timestamp_ntz'{CLOSING}' - interval 1 day")


@register("stream_lags", "SELECT event_id, event_type, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 DAY THEN lag(event_type) OVER w END AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def stream_lags(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with the user's event before it within a day, from three batches of files that all span the whole time."""
    table, path = read_table(spark, sf, "events"), new_path(spark)
    for k in range(3):
        table.where(F.col("event_id") % 3 == k).write.mode("append").parquet(path)
    # As many files as tasks wrote: a batch takes a third, so that the number of batches doesn't follow the table.
    files, delay = max(1, -(-len(spark.read.schema(events.SCHEMA).parquet(path).inputFiles()) // 3)), _delay(spark, path)
    _close(spark, path)
    with _rocksdb(spark):
        found = _append(events.lags(events.read_events(spark, path, files, delay), 86400))
    return found.where("user_id >= 0").select("event_id", "event_type", "before")
