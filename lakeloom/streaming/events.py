"""Structured Streaming over the `events` table: windows, deduplication, joins, and state.

Event time is cast to a zoned timestamp, which watermarks need. Every plan is
lazy: the caller picks sink, output mode and checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1, delay: str = "1 hour") -> DataFrame:
    """A stream of event files, oldest first, with a watermark on `ts`."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def disorder(spark: SparkSession, path: str) -> float:
    """Seconds by which rows of a file may be older than the newest row of files that a stream reads before it.

    Files are read by modification time; those of equal times in any order. A
    watermark with this delay leaves no row late, and lets state go as soon as
    the files allow: for files in the order of time it is 0, however long the
    table's span. One row for each file comes to the driver, which lists the
    files of a stream anyway.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    files = spark.read.schema(SCHEMA).parquet(path).select(at.alias("t"), F.col("_metadata.file_path").alias("f"), F.unix_micros("_metadata.file_modification_time").alias("m"))
    found = sorted(tuple(r) for r in files.groupBy("f", "m").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select("m", "lo", "hi").collect() if r["lo"] is not None)
    most = 0
    for i, (m, lo, _) in enumerate(found):
        most = max([most, *(hi - lo for j, (m2, _, hi) in enumerate(found) if m2 <= m and j != i)])
    return most / 1e6


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Count and sum by event type and window of fixed size."""
    out = events.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    """Count by overlapping windows."""
    return events.groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def session_counts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Events in each user's session."""
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def without_repeats(events: DataFrame, keys: list[str]) -> DataFrame:
    """Drop repeats that arrive within the watermark's delay."""
    return events.dropDuplicatesWithinWatermark(keys)


def followed_by(first: DataFrame, then: DataFrame, within: str) -> DataFrame:
    """Pairs of two streams: an event of `first`, then one of `then` of the same user within a time."""
    a = first.select(F.col("user_id"), F.col("ts").alias("first_ts"), F.col("event_id").alias("first_id"))
    b = then.select(F.col("user_id").alias("user2"), F.col("ts").alias("then_ts"), F.col("event_id").alias("then_id"))
    return a.join(b, F.expr(f"user_id = user2 AND then_ts >= first_ts AND then_ts <= first_ts + interval {within}")).drop("user2")


#: Groups of users that share a state, so that each call from Python to the store serves many users.
BUCKETS = 512
#: Rows of a stored chunk at most.
CHUNK = 1 << 16
_BYTES = T.StructType([T.StructField("rows", T.BinaryType())])


def _bucketed(events: DataFrame, buckets: int, columns: list[Column]) -> GroupedData:
    """Rows by bucket of their user; `user_id` is 0 where it is null, which `nobody` tells."""
    user = [F.coalesce("user_id", F.lit(0)).alias("user_id"), F.col("user_id").isNull().alias("nobody")]
    return events.select(F.pmod(F.hash("user_id"), F.lit(buckets)).alias("bucket"), *user, *columns).groupBy("bucket")


def _pack(df: pd.DataFrame) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(df, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpack(row: tuple) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(row[0])).read_pandas()


def _users(df: pd.DataFrame) -> pd.Series:
    return df["user_id"].astype("Int64").mask(df["nobody"])


class RunningTotal(StatefulProcessor):
    """Emits each user's count and sum so far, once for each batch that has events of the user."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", _BYTES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        by, sums = ["nobody", "user_id"], {"n": "sum", "total": "sum"}
        # One row for each user and chunk of the batch, so that no more is held than users.
        parts = [pdf.assign(n=1, total=pdf["value"]).groupby(by, as_index=False).agg(sums) for pdf in rows]
        fresh = pd.concat(parts).groupby(by, as_index=False).agg(sums)
        if self.state.exists():
            known = _unpack(self.state.get())
            known = pd.concat([known, fresh]).groupby(by, as_index=False).agg(sums)
        else:
            known = fresh
        self.state.update(_pack(known))
        out = fresh[by].merge(known, on=by)
        yield pd.DataFrame({"user_id": _users(out), "n": out["n"], "total": out["total"]})

    def close(self) -> None:
        pass


def running_totals(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Arbitrary keyed state: user_id, n, total. Users are kept in `buckets` states, each written as a whole; needs the RocksDB state store."""
    return _bucketed(events, buckets, [F.col("value")]).transformWithStateInPandas(statefulProcessor=RunningTotal(), outputStructType="user_id long, n long, total double", outputMode="Update", timeMode="None")


class Lags(StatefulProcessor):
    """Each event with the type of the user's event before it, in the order of time, though rows arrive in any order.

    Rows of a bucket of users wait in a list of chunks until the watermark has
    passed them: no older row can come after that. They are read only once it
    has passed the oldest; a timer stands there. The last event of a user is
    forgotten once the watermark is `within` seconds past it.
    """

    def __init__(self, within: float):
        self.within = int(within * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _BYTES)
        self.last = handle.getValueState("last", _BYTES)
        self.oldest = handle.getValueState("oldest", T.StructType([T.StructField("at", T.LongType())]))

    def _passed(self, watermark: int) -> Iterator[pd.DataFrame]:
        """Rows up to the watermark, in order; sets the next timer."""
        oldest = self.oldest.get()[0] if self.oldest.exists() else None
        if oldest is not None and -(-oldest // 1000) > watermark:
            self.handle.registerTimer(-(-oldest // 1000))
            return
        last = _unpack(self.last.get()) if self.last.exists() else None
        if oldest is not None:
            rows = pd.concat([_unpack(r) for r in self.waiting.get()], ignore_index=True)
            ready = -(-rows["at"] // 1000) <= watermark
            rest, rows = rows[~ready], rows[ready]
            if len(rest):
                self.waiting.put([_pack(rest.iloc[i : i + CHUNK]) for i in range(0, len(rest), CHUNK)])
                oldest = int(rest["at"].min())
                self.oldest.update((oldest,))
            else:
                self.waiting.clear()
                self.oldest.clear()
                oldest = None
            rows = rows.assign(new=True) if last is None else pd.concat([last.assign(new=False), rows.assign(new=True)], ignore_index=True)
            rows = rows.sort_values(["nobody", "user_id", "new", "at", "event_id"], ignore_index=True)
            user, nobody = rows["user_id"].to_numpy(), rows["nobody"].to_numpy()
            same = np.r_[False, (user[1:] == user[:-1]) & (nobody[1:] == nobody[:-1])]
            near = same & (rows["at"] - rows["at"].shift(fill_value=0) <= self.within)
            out = pd.DataFrame({"user_id": _users(rows), "event_id": rows["event_id"], "event_type": rows["event_type"], "before": rows["event_type"].shift().where(near, None)})
            last = rows.drop(columns="new")[~np.r_[same[1:], False]]
            yield out[rows["new"]]
        if last is not None:
            last = last[last["at"] + self.within >= watermark * 1000]
            if len(last):
                self.last.update(_pack(last))
            else:
                self.last.clear()
        if oldest is not None:
            self.handle.registerTimer(-(-oldest // 1000))
        elif last is not None and len(last):
            self.handle.registerTimer((int(last["at"].max()) + self.within) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        oldest = self.oldest.get()[0] if self.oldest.exists() else None
        for pdf in rows:
            self.waiting.appendValue(_pack(pdf[["nobody", "user_id", "at", "event_id", "event_type"]]))
            at = int(pdf["at"].min())
            oldest = at if oldest is None else min(at, oldest)
        self.oldest.update((oldest,))
        yield from self._passed(timer_values.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        yield from self._passed(timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def lags(events: DataFrame, within: float, buckets: int = BUCKETS) -> DataFrame:
    """user_id, event_id, event_type, before: the type of the user's event before, if it is at most `within` seconds older, else null.

    What `lag` over a window by user gives for a finished table; on a stream
    Spark has no such window. Needs the RocksDB state store. An event comes out
    once the watermark has passed it. Users are kept in `buckets` states: the
    waiting rows of one are in memory at once when they come out.
    """
    columns = [F.col("ts"), F.unix_micros("ts").alias("at"), F.col("event_id"), F.col("event_type")]
    return _bucketed(events, buckets, columns).transformWithStateInPandas(statefulProcessor=Lags(within), outputStructType="user_id long, event_id long, event_type string, before string", outputMode="Append", timeMode="EventTime")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there and stop, into Parquet files."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
