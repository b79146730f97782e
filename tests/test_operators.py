import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.functions import scalars
from lakeloom.operators import joins, windows


def test_asof_ties_nulls_and_tolerance(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 5), (4, None, 10), (5, "a", None), (6, "a", 100)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 10, 1, 7), ("a", 10, 2, 7), ("a", 15, None, 7), ("b", 6, 9, 7), (None, 1, 8, 7), ("a", None, 5, 7)], "k string, t long, v long, id long")
    got = {r.id: r.v for r in joins.asof_join(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert got == {1: 2, 2: None, 3: None, 4: None, 5: None, 6: None}
    near = joins.asof_join(left, right.where("v is not null"), ["k"], "t", "t", ["v"], F.lit(50))
    assert {r.id: r.v for r in near.collect()} == {1: 2, 2: 2, 3: None, 4: None, 5: None, 6: None}
    assert joins.asof_join(left.limit(0), right, ["k"], "t", "t", ["v"]).count() == 0


def test_interval_join(spark):
    rng = random.Random(1)
    pts = [(i, rng.uniform(-50, 50), rng.choice("xy")) for i in range(200)] + [(900, None, "x"), (901, 10.0, "x")]
    ivs = [(i, a := rng.uniform(-50, 50), a + rng.choice([0, 0.5, 30]), rng.choice("xy")) for i in range(60)] + [(700, 5.0, 4.0, "x"), (701, None, 3.0, "x"), (702, 10.0, 10.0, "x")]
    p, v = spark.createDataFrame(pts, "p long, x double, k string"), spark.createDataFrame(ivs, "v long, lo double, hi double, k string")
    got = sorted((r.p, r.v) for r in joins.interval_join(p, v, "x", "lo", "hi", 7.0, ["k"]).collect())
    want = sorted((i, j) for i, x, k in pts for j, a, b, m in ivs if x is not None and a is not None and k == m and a <= x <= b)
    assert got == want


def test_salted_join_equals_join(spark):
    a = spark.createDataFrame([(i, 1 if i % 3 else i % 7) for i in range(300)], "id long, k long")
    b = spark.createDataFrame([(i, f"n{i}") for i in range(0, 9, 2)] + [(1, "again"), (1, "more")], "k long, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, joins.salted_join(a, b, ["k"], 5, how).collect())) == sorted(map(str, a.join(b, "k", how).collect()))


def test_window_forms(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 1, 20.0), ("a", 2, None), ("a", 4, 5.0), ("b", 1, 1.0)], "k string, o long, v double")
    near = windows.over_groups(df, "s", F.sum("v"), ["k"], "o", 1, 0)
    assert sorted((r.k, r.o, r.s) for r in near.collect()) == [("a", 1, 30.0), ("a", 1, 30.0), ("a", 2, 30.0), ("a", 4, 5.0), ("b", 1, 1.0)]
    w = Window.partitionBy("k").orderBy("o", "v").rowsBetween(-1, 1)
    got = df.select("k", "o", "v", windows.sum_excluding_row("v", w).alias("s")).collect()
    assert sorted((r.k, r.o, r.v or 0, r.s) for r in got) == [("a", 1, 10.0, 20.0), ("a", 1, 20.0, 10.0), ("a", 2, 0, 25.0), ("a", 4, 5.0, None), ("b", 1, 1.0, None)]
    assert windows.top_k(df, ["k"], [F.col("o")], 1, ties=True).count() == 3
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([("u", t), ("u", t + dt.timedelta(minutes=30)), ("u", t + dt.timedelta(minutes=61)), ("v", t)], "u string, ts timestamp")
    assert sorted((r.u, r.session_no) for r in windows.sessions(ev, ["u"], "ts", "30 minutes").collect()) == [("u", 1), ("u", 1), ("u", 2), ("v", 1)]


def test_scalars(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 2.0)], "a array<double>, b array<double>, x double")
    got = df.select(scalars.dot(F.col("a"), F.col("b")).alias("d"), scalars.cosine(F.col("a"), F.col("b")).alias("c"), scalars.safe_ratio(F.lit(1.0), F.col("x")).alias("r")).collect()
    assert got[0].d == 11 and abs(got[0].c - 11 / (5**0.5 * 5)) < 1e-12 and got[0].r is None
    assert got[1].c is None and got[1].r == 0.5
    few = spark.range(2).agg(scalars.sample_skewness("id").alias("s"), scalars.sample_kurtosis("id").alias("k")).first()
    assert few.s is None and few.k is None


def test_interval_join_of_long_intervals(spark):
    """Intervals of a millionth to a million bucket widths: none is copied to more than a few buckets."""
    rng = random.Random(4)
    pts = [(i, rng.uniform(-1e6, 1e6)) for i in range(300)]
    ivs = [(i, a := rng.uniform(-1e6, 1e6), a + 10 ** rng.uniform(-6, 6)) for i in range(150)]
    p, v = spark.createDataFrame(pts, "p long, x double"), spark.createDataFrame(ivs, "v long, lo double, hi double")
    got = sorted((r.p, r.v) for r in joins.interval_join(p, v, "x", "lo", "hi", 1.0).collect())
    assert got == sorted((i, j) for i, x in pts for j, a, b in ivs if a <= x <= b)


def test_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a long")
    right = lambda *x: spark.createDataFrame([(i,) for i in x], "b long")
    got = lambda r: sorted((x.a for x in joins.not_in(left, r, "a", "b").collect()), key=str)
    assert got(right(1)) == [2] and got(right(1, None)) == [] and got(right(None).where("b > 0")) == [1, 2, None]


def test_percentile(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([rng.gauss(0, 1), 7.0, rng.randrange(5), 1e9 * rng.random()])) for _ in range(500)] + [("c", 3.0), ("d", None)]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "k string, v double")
    for p in (0.0, 0.37, 0.5, 0.99, 1.0):
        want = {r.k: r.x for r in df.groupBy("k").agg(F.percentile("v", p).alias("x")).collect() if r.x is not None}
        got = {r.k: r.x for r in windows.percentile(df, ["k"], "v", p, "x").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)


def test_excluded_peers(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 1, 20.0), ("a", 2, None), ("b", 1, 1.0)], "k string, o long, v double")
    got = df.select("k", "o", "v", windows.sum_excluding_peers("v", ["k"], "o").alias("g"), windows.sum_excluding_peers("v", ["k"], "o", True).alias("t")).collect()
    assert sorted((r.k, r.o, r.v or 0, r.g, r.t) for r in got) == [("a", 1, 10.0, None, 10.0), ("a", 1, 20.0, None, 20.0), ("a", 2, 0, 30.0, 30.0), ("b", 1, 1.0, None, 1.0)]


def test_ties_of_arg_extremes_go_to_the_smallest_key(spark, tmp_path):
    from lakeloom.plans import registry

    rows = [(7, 5.0, "a"), (3, 5.0, "a"), (9, 5.0, "a"), (8, -1.0, "a"), (2, -1.0, "a"), (4, -1.0, "a"), (1, None, "a"), (None, 9.0, "a"), (6, None, "b")]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = registry.queries()["arg_extremes"](spark, str(tmp_path)).collect()
    assert {r.c_mktsegment: (r.richest, r.poorest) for r in got} == {"a": (3, 2), "b": (None, None)}
