"""Running values over ranges, inequality joins, evaluation and stored sketches against plain computations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import evaluation, inequality, joins, ranges, sketches, windows


def test_running_sums_and_last_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1, 2, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    got = {r.o: (r.s, r.all) for r in ranges.running_sums(df, ["k"], ["o"], {"s": F.col("v")}, {"s": "all"}).collect()}
    last = {r.o: r.v for r in ranges.last_values(df, ["k"], ["o"], "v").collect()}
    for k, o, _ in rows:
        mine = [v for k2, o2, v in rows if k2 == k and o2 <= o and v is not None]
        assert got[o] == (sum(mine), sum(v or 0 for k2, _, v in rows if k2 == k))
        assert last[o] == (mine[-1] if mine else None)
    none = {r.o: r.s for r in ranges.running_sums(df, [], ["o"], {"s": F.lit(1)}).collect()}
    assert none == {o: o + 1 for o in range(400)}
    assert ranges.running_sums(df.limit(0), ["k"], ["o"], {"s": F.col("v")}).count() == 0


def test_a_hot_key_spreads_over_tasks(spark):
    df = spark.range(8000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    sizes = [r["count"] for r in ranges.ranged(df, ["k"], ["o"]).groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 3500


def test_spread_asof_join_equals_the_window(spark):
    rng = random.Random(2)
    left = spark.createDataFrame([(i, rng.choice(["a", "a", "b", None]), rng.choice([None, *range(30)])) for i in range(300)], "id long, k string, t long").repartition(3)
    right = spark.createDataFrame([(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(30)]), rng.choice([None, 1, 2, 3])) for _ in range(80)], "k string, t long, v long").repartition(3)
    for tolerance in (None, F.lit(2)):
        a, b = ({r.id: r.v for r in joins.asof_join(left, right, ["k"], "t", "t", ["v"], tolerance, spread).collect()} for spread in (False, True))
        assert a == b and len(a) == 300 and len(set(a.values())) > 2


@pytest.mark.parametrize("shape", ["plain", "outlier", "one value"])
def test_percentiles_of_null_keys_and_outliers(spark, shape):
    rng = random.Random(3)
    value = {"plain": lambda: rng.gauss(0, 1), "outlier": lambda: rng.choice([rng.gauss(0, 1), 1.0, -1e300, 1e300]), "one value": lambda: 4.0}[shape]
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1]), value()) for _ in range(600)] + [("c", None, None), ("d", 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, m long, v double")
    shares = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.99, "e": 1.0}
    want = {(r.k, r.m): r for r in df.groupBy("k", "m").agg(*[F.percentile("v", p).alias(c) for c, p in shares.items()]).collect() if r.a is not None}
    got = {(r.k, r.m): r for r in windows.percentile(df, ["k", "m"], "v", shares).collect()}
    assert got.keys() == want.keys() and (None, None) in got
    for k, r in got.items():
        assert all(r[c] == want[k][c] or abs(r[c] - want[k][c]) <= 1e-9 * abs(want[k][c]) for c in shares), (k, r, want[k])
    found = {(r.k, r.m): r for r in windows.discrete_percentile(df, ["k", "m"], "v", shares).collect()}
    assert found.keys() == want.keys()
    for (k, m), r in found.items():
        vs = sorted(v for a, b, v in rows if (a, b) == (k, m) and v is not None)
        assert all(r[c] == vs[max(1, math.ceil(p * len(vs))) - 1] for c, p in shares.items())


def holds(a, op, b):
    if a is None or b is None:
        return False
    a, b = ((1, 0) if x != x else (0, x) for x in (a, b))
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


@pytest.mark.parametrize("ops", [("<", "<"), ("<=", ">"), (">", ">="), (">=", "<=")])
def test_inequality_join(spark, monkeypatch, ops):
    monkeypatch.setattr(inequality, "BLOCK", 20)
    monkeypatch.setattr(inequality, "BATCH", 50)
    rng = random.Random(4)
    number = lambda: rng.choice([None, float("nan"), 3.0, 3.0, rng.uniform(0, 9), float(rng.randrange(9)), float("inf"), -0.0])
    ls = [(i, number(), rng.choice([None, 5, 5, rng.randrange(20)]), f"l{i}") for i in range(130)]
    rs = [(i, number(), rng.choice([None, 5, rng.randrange(20)])) for i in range(90)] + [(90, 3.0, 5)] * 60  # a hot value
    left, right = spark.createDataFrame(ls, "a long, x double, y int, name string").repartition(3), spark.createDataFrame(rs, "b long, u double, w long").repartition(2)
    got = sorted((r.a, r.b) for r in inequality.inequality_join(left, right, ("x", ops[0], "u"), ("y", ops[1], "w")).collect())
    assert got == sorted((l[0], r[0]) for l in ls for r in rs if holds(l[1], ops[0], r[1]) and holds(l[2], ops[1], r[2]))
    out = inequality.inequality_join(left, right, ("x", ops[0], "u"), ("y", ops[1], "u"))
    assert out.columns == ["a", "x", "y", "name", "b", "u", "w"]
    assert sorted((r.a, r.b) for r in out.collect()) == sorted((l[0], r[0]) for l in ls for r in rs if holds(l[1], ops[0], r[1]) and holds(l[2], ops[1], r[1]))
    assert inequality.inequality_join(left, right.limit(0), ("x", "<", "u"), ("y", "<", "w")).count() == 0


def test_inequality_join_of_times_and_its_limits(spark):
    a = spark.sql("SELECT id AS i, timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int)) AS t, date'2024-01-01' + cast(id as int) AS d FROM range(30)")
    b = a.withColumnsRenamed({"i": "j", "t": "t2", "d": "d2"})
    got = inequality.inequality_join(a, b, ("t", "<", "t2"), ("d", ">=", "d2"))
    assert got.count() == 0 and inequality.inequality_join(a, b, ("t", "<", "t2"), ("d", "<=", "d2")).count() == 435
    big = spark.createDataFrame([(2**62, 0), (2**62 + 1, 0)], "x long, y long")
    assert inequality.inequality_join(big, big.withColumnsRenamed({"x": "u", "y": "w"}), ("x", "<", "u"), ("y", "<=", "w")).collect() == [(2**62, 0, 2**62 + 1, 0)]
    with pytest.raises(ValueError, match="both sides"):
        inequality.inequality_join(a, a, ("t", "<", "t"), ("d", "<", "d"))
    with pytest.raises(TypeError):
        inequality.inequality_join(a, b, ("t", "<", "d2"), ("d", "<", "d2"))
    with pytest.raises(ValueError, match="operator"):
        inequality.inequality_join(a, b, ("t", "=", "t2"), ("d", "<", "d2"))


def test_blocks_without_a_match_are_dropped():
    import numpy as np
    import pandas as pd

    ends = np.array([[b, 10.0 * b, 10.0 * b + 9, 0, 1] for b in range(10)])
    left = pd.DataFrame([(0, 50.0, 59.0, 5.0, 6.0), (1, 50.0, 59.0, 0.5, 6.0), (2, float("nan"), float("nan"), 0.0, 0.0)], columns=["block", "xlo", "xhi", "ylo", "yhi"])
    found = pd.concat(inequality._pairs(ends, ("<", "<"))(iter([left])))
    assert found[found.l == 0].empty and found[found.l == 1].r.tolist() == [5, 6, 7, 8, 9] and len(found[found.l == 2]) == 10


def test_auc_and_curves(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", None]), rng.choice([None, 1.0, 2.0, float(rng.randrange(6)), float("nan")]), rng.choice([None, True, False])) for _ in range(300)] + [("only", 1.0, True)]
    df = spark.createDataFrame(rows, "k string, s double, y boolean")
    up = lambda s: (s != s, 0 if s != s else s)
    got = {r.k: r for r in evaluation.auc(df, ["k"], "s", "y").collect()}
    curve = {(r.k, str(r.s)): r for r in evaluation.threshold_curve(df, ["k"], "s", "y").collect()}
    best = {r.k: r for r in evaluation.best_thresholds(df, ["k"], "s", "y").collect()}
    for k in ("a", None, "only"):
        pos = [up(s) for a, s, y in rows if a == k and s is not None and y is True]
        neg = [up(s) for a, s, y in rows if a == k and s is not None and y is False]
        won = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert (got[k].positives, got[k].negatives) == (len(pos), len(neg))
        assert got[k].auc is None if not neg else abs(got[k].auc - won / len(pos) / len(neg)) < 1e-12
        f1s = []
        for s in {str(s): s for a, s, y in rows if a == k and s is not None and y is not None}.values():
            r, tp, fp = curve[k, str(s)], sum(p >= up(s) for p in pos), sum(n >= up(s) for n in neg)
            assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, len(pos) - tp, len(neg) - fp)
            assert r.recall == tp / len(pos) and r.precision == tp / (tp + fp)
            f1s.append((r.f1, up(s)))
        assert (best[k].f1, up(best[k].s)) == max(f1s)
    assert evaluation.auc(df.limit(0), ["k"], "s", "y").count() == 0


def test_stored_sketches(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(5), rng.choice([None, *range(-40, 300)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "day long, v long")
    states = sketches.distinct_states(df, ["day"], "v")
    merged = sketches.merged_distinct(states.withColumn("half", F.col("day") < 2), ["half"])
    assert {r.half: r.estimate for r in merged.collect()} == {h: len({v for d, v in rows if v is not None and (d < 2) == h}) for h in (True, False)}
    few = sketches.merged_distinct(sketches.distinct_states(spark.range(50000).withColumn("k", F.lit(1)), ["k"], "id"), ["k"]).first().estimate
    assert abs(few - 50000) < 4000
    for width in (7, 1024):
        counts = sketches.merged_counts(sketches.count_states(df, ["day"], "v", 3, width), [])
        asked = df.select("v").where("v is not null").distinct().unionByName(spark.createDataFrame([(10**15,)], "v long"))
        got = {r.v: r.estimate for r in sketches.estimated_counts(counts, asked, [], "v", 3, width).collect()}
        exact = {v: sum(1 for _, x in rows if x == v) for v in got}
        assert all(got[v] >= exact[v] for v in got) and len(got) > 300
        assert width == 7 or sum(got[v] == exact[v] for v in got) > 0.9 * len(got)


def test_merged_sketches_are_exact_beyond_their_size(spark):
    """Days of 300 values, 10 shared with the next, in sketches of 64: a merged state would hold 2,910."""
    df = spark.range(3000).selectExpr("id DIV 300 AS day", "id - 10 * (id DIV 300) AS v").unionByName(spark.createDataFrame([(0, None), (77, None)], "day long, v long"))
    states = sketches.distinct_states(df, ["day"], "v", 6)
    assert states.select("part").distinct().count() > 100
    got = {r.day: r.estimate for r in sketches.merged_distinct(states, ["day"], 6).collect()}
    assert got == {**dict.fromkeys(range(10), 300), 77: 0}
    assert sketches.merged_distinct(states, [], 6).first().estimate == 2910
    assert sketches.merged_distinct(sketches.distinct_states(df, ["day"], "v", 6, parts=1), [], 6).first().estimate != 2910


def test_sketches_of_many_users(spark, tmp_path):
    """More users than a sketch of the query holds."""
    from lakeloom.plans import registry

    rows = spark.range(120000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 3 as int)) AS ts", "id % 40000 AS user_id", "if(id % 4 = 0, 'a', 'b') AS event_type", "cast(id as double) AS value", "'' AS props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_type: (r.users, r.shared, r.middle_close) for r in registry.queries()["sketches"](spark, str(tmp_path)).collect()}
    assert got == {"a": (10000, 10000, True), "b": (30000, 30000, True)}
    assert sorted((r.estimate, r.exact) for r in registry.queries()["sketch_users"](spark, str(tmp_path)).collect()) == [(40000, 40000)] * 3


def test_rows_beyond_the_other_side_are_not_dealt(spark, monkeypatch):
    """Of 1,000 rows of each side those that match the other side's ends are put in blocks."""
    packed = []
    plain = inequality._blocks
    monkeypatch.setattr(inequality, "_blocks", lambda rows: (packed.append(rows.count()), plain(rows))[1])
    left = spark.range(1000).selectExpr("id AS a", "cast(id as double) AS x", "id AS y")
    right = spark.range(1000).selectExpr("id AS b", "id - 990D AS u", "id AS w")
    got = sorted((r.a, r.b) for r in inequality.inequality_join(left, right, ("x", "<", "u"), ("y", ">=", "w")).collect())
    assert got == sorted((a, b) for a in range(1000) for b in range(990, 1000) if a < b - 990 and a >= b)
    assert packed[0] == 9 and packed[1] <= 9
    packed.clear()
    got = sorted((r.a, r.b) for r in inequality.inequality_join(left, right, ("x", "<=", "u"), ("y", "<", "w")).collect())
    assert got == sorted((a, b) for a in range(10) for b in range(990 + a, 1000)) and packed == [10, 10]


def test_the_joins_result_takes_little_when_written(spark, tmp_path):
    """Runs of the side with more columns and repeats of the other: 196,000 rows in under 200,000 bytes."""
    left = spark.range(400).select(F.col("id").alias("a"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    right = spark.range(2000).select(F.col("id").alias("b"), (F.col("id") % 7).alias("c"), F.floor(F.rand(5) * 20000).alias("d"), F.rand(3).alias("u"), F.rand(4).alias("v"))
    for name, df in (("l", left), ("r", right)):
        df.write.parquet(str(tmp_path / name))
    left, right = (spark.read.parquet(str(tmp_path / name)) for name in "lr")
    inequality.inequality_join(left, right, ("x", "<", "u"), ("y", "<", "v")).select("a", "b", "c", "d").write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    want = left.join(right, (F.col("x") < F.col("u")) & (F.col("y") < F.col("v"))).select("a", "b", "c", "d")
    assert out.exceptAll(want).count() == want.exceptAll(out).count() == 0 and out.count() > 150000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < out.count()


def test_products_of_two_blocks_are_bounded_and_whole(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(7)
    lx, ly, rx, ry = (rng.integers(0, 9, n).astype(float) for n in (60, 60, 200, 200))
    lx[:3], ry[:5] = np.nan, np.nan
    for tile, product in ((2048, 1 << 14), (7, 20)):
        monkeypatch.setattr(inequality, "TILE", tile)
        monkeypatch.setattr(inequality, "PRODUCT", product)
        for ops in (("<", "<"), ("<=", ">"), (">", ">="), (">=", "<=")):
            want = sorted((i, j) for i in range(60) for j in range(200) if holds(lx[i], ops[0], rx[j]) and holds(ly[i], ops[1], ry[j]))
            for inner in (0, 1):
                found = list(inequality.matches(lx, ly, rx, ry, ops, inner))
                assert sorted((i, j) if inner else (j, i) for a, b in found for i in a for j in b) == want
                assert all(len(a) * len(b) <= max(product, len(b)) and len(b) <= tile for a, b in found)


def test_blocks_travel_once_to_a_task_of_several(spark, monkeypatch):
    """40 by 40 blocks all meet: each goes to 5 tasks, not to 40 pairs."""
    ids = spark.createDataFrame([(b, b"") for b in range(40)], "block long, rows binary")
    pairs = spark.range(40).select(F.col("id").alias("o")).crossJoin(spark.range(40).select(F.col("id").alias("i")))
    rows = inequality._dealt(pairs, ids, ids).withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) == 2 * 40 * 5 and len({r.part for r in rows}) == len({r.task for r in rows}) == 25
    inner = {(r.task, r.block) for r in rows if r.needed is None}
    met = [(b, r.block) for r in rows if r.needed is not None for b in r.needed if (r.task, b) in inner]
    assert sorted(met) == sorted((i, o) for i in range(40) for o in range(40))


def test_inequality_join_returns_the_named_columns(spark):
    left, right = spark.range(4).selectExpr("id AS a", "id AS x", "'l' AS n"), spark.range(4).selectExpr("id AS b", "id AS u", "'r' AS m")
    join = lambda names: inequality.inequality_join(left, right, ("a", "<", "b"), ("x", "<=", "u"), names)
    assert join(["m", "a"]).columns == ["m", "a"] and sorted(r.a for r in join(["m", "a"]).collect()) == [0, 0, 0, 1, 1, 2]
    assert [tuple(r) for r in join(["m"]).collect()] == [("r",)] * 6
    with pytest.raises(ValueError, match="neither"):
        join(["q"])
