"""Streams over event files, oldest first, closed by one late row, against batch results."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.plans import streams
from lakeloom.streaming import events as ev

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Four files in time order, each event with a user, then a sentinel far ahead that closes every window."""
    path, rng = tmp_path_factory.mktemp("events"), random.Random(4)
    rows = sorted((T0 + dt.timedelta(minutes=rng.randrange(6000)), i) for i in range(400))
    rows = [(i, t, i % 11, ["click", "purchase", "view"][i % 3], float(i), "{}") for t, i in rows]
    parts = [rows[k : k + 100] for k in range(0, 400, 100)] + [[(9999, dt.datetime(2030, 1, 1), -1, "end", 0.0, "{}")]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, ev.SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
        for f in path.glob("*.parquet"):
            if not (path / (f.name + ".seen")).exists():
                os.utime(f, (1_700_000_000 + k * 10,) * 2)
                (path / (f.name + ".seen")).write_text("")
    for f in [*path.glob("*.seen"), *path.glob(".*"), *path.glob("_*")]:
        f.unlink()
    return str(path)


def collect(spark, stream, tmp_path, mode="append"):
    ev.run_once(stream, str(tmp_path / "out"), str(tmp_path / "ck"), mode)
    return spark.read.parquet(str(tmp_path / "out"))


def test_tumbling_and_sliding(spark, files, tmp_path):
    batch = spark.read.parquet(files).where("user_id >= 0").withColumn("ts", F.col("ts").cast("timestamp"))
    for i, f in enumerate((ev.tumbling, ev.sliding)):
        got = collect(spark, f(ev.read_events(spark, files)), tmp_path / str(i)).where("start < '2029-01-01'")
        assert sorted(map(str, got.collect())) == sorted(map(str, f(batch).collect()))


def test_sessions(spark, files, tmp_path):
    batch = spark.read.parquet(files).where("user_id >= 0").withColumn("ts", F.col("ts").cast("timestamp"))
    got = collect(spark, ev.session_counts(ev.read_events(spark, files)), tmp_path).where("user_id >= 0")
    assert sorted(map(str, got.collect())) == sorted(map(str, ev.session_counts(batch).collect()))


def test_repeats_are_dropped(spark, files, tmp_path):
    s = ev.read_events(spark, files)
    got = collect(spark, ev.without_repeats(s.unionByName(s), ["event_id"]), tmp_path)
    assert got.count() == got.select("event_id").distinct().count() == 401


def test_stream_stream_join(spark, files, tmp_path):
    s = lambda kind: ev.read_events(spark, files).where(F.col("event_type").isin(kind, "end"))
    got = collect(spark, ev.followed_by(s("click"), s("purchase"), "2 hours"), tmp_path).where("first_id <> 9999")
    b = spark.read.parquet(files)
    a, c = b.where("event_type = 'click'").alias("a"), b.where("event_type = 'purchase'").alias("c")
    want = a.join(c, F.expr("a.user_id = c.user_id and c.ts >= a.ts and c.ts <= a.ts + interval 2 hours"))
    assert sorted((r.first_id, r.then_id) for r in got.collect()) == sorted((r[0], r[1]) for r in want.select("a.event_id", "c.event_id").collect())


def test_keyed_state(spark, files, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = ev.running_totals(ev.read_events(spark, files)).writeStream.format("memory").queryName("totals").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if old is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = {r.user_id: (r.n, r.total) for r in spark.table("totals").groupBy("user_id").agg(F.max("n").alias("n"), F.max("total").alias("total")).collect()}
    want = {r.user_id: (r.n, r.t) for r in spark.read.parquet(files).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("t")).collect()}
    assert got == want


def test_files_that_overlap_in_time_lose_no_rows(spark, tmp_path):
    """The latest event stands in the first file, the earliest in the last one."""
    rows = [(i, T0 + dt.timedelta(hours=9 * (i % 21), minutes=i), i % 3, ["click", "purchase"][i % 2], 1.0, "{}") for i in range(120)]
    for k in range(4):
        spark.createDataFrame(rows[::-1][k::4], ev.SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"events{k}.parquet"))
    got = streams.stream_no_repeats(spark, str(tmp_path)).collect()
    assert sorted(r.event_id for r in got) == list(range(120))
    pairs = sorted((a[0], b[0]) for a in rows for b in rows if a[2] == b[2] and a[3] == "click" and b[3] == "purchase" and dt.timedelta() <= b[1] - a[1] <= dt.timedelta(hours=1))
    assert pairs and sorted((r.first_id, r.then_id) for r in streams.stream_follow_up(spark, str(tmp_path)).collect()) == pairs


def test_disorder_is_what_files_overlap_by(spark, tmp_path):
    def put(name, hours, at):
        rows = [(h, T0 + dt.timedelta(hours=h), 1, "click", 1.0, "{}") for h in hours]
        spark.createDataFrame(rows, ev.SCHEMA).coalesce(1).write.parquet(str(tmp_path / name))
        for f in (tmp_path / name).glob("*.parquet"):
            os.utime(f, (1_700_000_000 + at,) * 2)

    put("a", [0, 10], 0)
    assert ev.disorder(spark, str(tmp_path / "*")) == 0
    put("b", [7, 30], 1)
    assert ev.disorder(spark, str(tmp_path / "*")) == 3 * 3600
    put("c", [30, 40], 2)
    assert ev.disorder(spark, str(tmp_path / "*")) == 3 * 3600
    put("d", [25, 50], 2)  # read before or after c
    assert ev.disorder(spark, str(tmp_path / "*")) == 20 * 3600


def test_lags_over_files_in_any_order(spark, tmp_path):
    """Rows of one user in all files, ties in time, pauses beyond the limit; equal to lag over the table."""
    rng = random.Random(8)
    rows = [(i, T0 + dt.timedelta(minutes=rng.randrange(4000)), i % 4, rng.choice("abc"), 1.0, "{}") for i in range(300)] + [(500, T0 + dt.timedelta(minutes=9000), 1, "z", 1.0, "{}")]
    path = str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame(rows[k::4], ev.SCHEMA).coalesce(1).write.mode("append").parquet(path)
    delay = streams._delay(spark, path)
    streams._close(spark, path)
    with streams._rocksdb(spark):
        got = collect(spark, ev.lags(ev.read_events(spark, path, delay=delay), 3 * 3600), tmp_path).where("user_id >= 0")
    want = {}
    for u in range(4):
        mine = sorted((t, i, kind) for i, t, v, kind, *_ in rows if v == u)
        for before, (t, i, kind) in zip([None, *mine], mine, strict=False):
            want[i] = (kind, before[2] if before and t - before[0] <= dt.timedelta(hours=3) else None)
    assert {r.event_id: (r.event_type, r.before) for r in got.collect()} == want
    assert {v[1] for v in want.values()} == {"a", "b", "c", None}


def test_users_of_one_state(spark, tmp_path):
    """All users, a null one too, in a single bucket: totals and lags are still those of each."""
    rng = random.Random(9)
    rows = [(i, T0 + dt.timedelta(minutes=rng.randrange(3000)), rng.choice([None, 0, 1, 2**60, 2**60 + 1]), rng.choice("abc"), float(i), "{}") for i in range(200)]
    path = str(tmp_path / "in")
    for k in range(2):
        spark.createDataFrame(rows[k::2], ev.SCHEMA).coalesce(1).write.mode("append").parquet(path)
    delay = streams._delay(spark, path)
    streams._close(spark, path)
    with streams._rocksdb(spark):
        got = collect(spark, ev.lags(ev.read_events(spark, path, delay=delay), 3600, buckets=1), tmp_path / "lags").where("event_id >= 0")
        totals = []
        keep = lambda df, _: totals.append([tuple(r) for r in df.where("user_id is null or user_id >= 0").collect()])
        ev.running_totals(ev.read_events(spark, path), buckets=1).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    want = {}
    for u in {r[2] for r in rows}:
        mine = sorted((t, i, kind) for i, t, v, kind, *_ in rows if v == u)
        for before, (t, i, _) in zip([None, *mine], mine, strict=False):
            want[i] = (u, before[2] if before and t - before[0] <= dt.timedelta(hours=1) else None)
    assert {r.event_id: (r.user_id, r.before) for r in got.collect()} == want
    assert {u: (n, s) for batch in totals for u, n, s in batch} == {u: (sum(r[2] == u for r in rows), sum(r[4] for r in rows if r[2] == u)) for u in {r[2] for r in rows}}


def test_batches_and_files_of_larger_tables(spark, tmp_path, monkeypatch):
    """A week of many rows is several files of one batch, written by as many tasks; lags take three batches however many files there are."""
    monkeypatch.setattr(streams, "FILE_ROWS", 60)
    rows = [(i, T0 + dt.timedelta(minutes=100 * i), i % 7, "abc"[i % 3], 1.0, "{}") for i in range(300)]
    spark.createDataFrame(rows, ev.SCHEMA).repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    asked = []
    plain = ev.read_events
    monkeypatch.setattr(ev, "read_events", lambda s, path, n=1, delay="1 hour": (asked.append((n, len(s.read.schema(ev.SCHEMA).parquet(path).inputFiles()))), plain(s, path, n, delay))[1])
    counts = streams.stream_running_counts(spark, str(tmp_path)).collect()
    days = streams.stream_tumbling_append(spark, str(tmp_path)).groupBy("event_type").agg(F.sum("n").alias("n")).collect()
    assert {r.user_id: r.n for r in counts} == {u: sum(r[2] == u for r in rows) for u in range(7)} and {r.event_type: r.n for r in days} == dict.fromkeys("abc", 100)
    assert asked[0][0] == 2 and asked[0][1] > 5
    found = streams.stream_lags(spark, str(tmp_path)).collect()
    assert len(found) == 300 and {r.event_id: r.before for r in found} == {i: "abc"[(i - 7) % 3] if i > 6 else None for i in range(300)}
    n, files = asked[-1]
    assert files > 4 and -(-files // n) <= 4
