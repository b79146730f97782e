"""Mixing overlapping sources to target weights by a minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources a document
counts for). The flow sends words from patterns to source quotas; an arc for
the r-th use of a pattern costs more than the one for the (r-1)-th, so the
cost of repetition is convex and every first use is spent before any second.
Only the aggregated patterns reach the driver: their number follows the
catalogue of sources, not the number of documents.

Whole documents are then selected in the order of a seeded hash. A prefix of
that order is found by histogram (4096 hash ranges per pattern), so that no
task ever sees more than one range of a hot source.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, words

MAX_REPEATS = 3
#: Cost of the first, second and third use of a word.
REPEAT_COST = (0, 1, 4)
#: Documents of a pattern that may be used once more to come nearer to its target.
FILLERS = 5
#: Part of a pattern's words by which these documents may leave it apart from its target.
TOLERANCE = 0.005


def water_fill(sizes: list[int], weights: list[float], cap: float = MAX_REPEATS) -> list[float]:
    """Targets that share sum(sizes) by weight, none above cap times its size; excess is shared anew by weight."""
    total, free, fixed = sum(sizes), set(range(len(sizes))), 0
    while free:
        level = (total - fixed) / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > cap * sizes[i]}
        if not over:
            break
        free -= over
        fixed += sum(cap * sizes[i] for i in over)
    return [level * weights[i] if i in free else float(cap * sizes[i]) for i in range(len(sizes))]


def min_cost_flow(supply: dict, quota: dict, member: dict, repeat_cost: tuple = REPEAT_COST) -> dict:
    """Words to take of each (pattern, repetition), as near to the quotas as capacity lets them.

    Successive shortest paths on source -> pattern (one arc for each repetition,
    capacity = the pattern's words, cost = `repeat_cost`) -> sources in the
    pattern -> sink (capacity = quota). Potentials keep costs non-negative.
    """
    arcs: list[list] = []
    graph: dict = defaultdict(list)

    def arc(u, v, cap, cost):
        graph[u].append(len(arcs))
        arcs.append([v, cap, cost])
        graph[v].append(len(arcs))
        arcs.append([u, 0, -cost])

    uses = {}
    for p, words_ in supply.items():
        for r, cost in enumerate(repeat_cost):
            uses[p, r] = len(arcs)
            arc("S", ("p", p), words_, cost)
        for s in member[p]:
            arc(("p", p), ("s", s), float("inf"), 0)
    for s, q in quota.items():
        arc(("s", s), "T", q, 0)
    potential: dict = defaultdict(float)
    while True:
        dist, back, heap, tie = {"S": 0.0}, {}, [(0.0, 0, "S")], 0
        while heap:
            d, _, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for a in graph[u]:
                v, cap, cost = arcs[a]
                new = d + cost + potential[u] - potential[v]
                if cap > 1e-6 and new < dist.get(v, float("inf")) - 1e-12:
                    tie += 1
                    dist[v], back[v] = new, a
                    heapq.heappush(heap, (new, tie, v))
        if "T" not in dist:
            break
        far = max(dist.values())
        for v in graph:
            potential[v] += dist.get(v, far)
        path, v = [], "T"
        while v != "S":
            path.append(back[v])
            v = arcs[back[v] ^ 1][0]
        push = min(arcs[a][1] for a in path)
        for a in path:
            arcs[a][1] -= push
            arcs[a ^ 1][1] += push
    return {key: arcs[a ^ 1][1] for key, a in uses.items()}


def seeded_order(key: Column, seed: int) -> Column:
    """A pseudo-random order that any SQL engine can repeat: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str | Column = "source", weights: tuple[float, ...] = (5, 2, 1), seed: int = 42, tolerance: float = TOLERANCE) -> DataFrame:
    """Choose how often each document is used so that sources come near their targets.

    `source` is a string column, or an array column for documents that count
    for several sources. Sources are ordered by code point, null last, and
    take `weights` in turn. Returns the input's id as `id_col`, with `size`
    (words), `source_size`, `target` (of the first source of the document),
    `taken` (words used, repeats counted), `repeats` and `text_hash` (xxhash64 of
    the text, which with the id names the row).

    Null and empty texts have size 0 and are never taken; a null source is a
    source of its own; repeated ids keep their own rows; an empty table gives
    an empty result. Documents are used whole, at most three times, and the
    same input gives the same choice. Where the first FILLERS documents leave
    a pattern more than `tolerance` apart from its words, documents that don't
    fit are skipped and the order goes on until none fits the gap.
    """
    src = F.col(f"`{source}`") if isinstance(source, str) else source
    is_array = docs.select(src.alias("s")).schema["s"].dataType.typeName() == "array"
    members = F.array_sort(F.array_distinct(F.when(src.isNull() | (F.size(src) == 0), F.array(F.lit(None).cast("string"))).otherwise(src))) if is_array else F.array(src.cast("string"))
    sized = docs.select(F.col(f"`{id_col}`").alias("_id"), members.alias("_m"), F.size(words(F.col(f"`{text_col}`"))).cast("long").alias("size"), F.xxhash64(F.col(f"`{text_col}`")).alias("_h"))
    sized = sized.withColumn("_o", seeded_order(F.col("_id"), seed)).withColumn("_r", F.conv(F.substring("_o", 1, 3), 16, 10).cast("int"))

    sized = materialize(sized)  # sizes are read several times, texts once

    ranges = sized.groupBy("_m", "_r").agg(F.sum("size").alias("words"))
    patterns = {tuple(r["_m"]): int(r["words"]) for r in ranges.groupBy("_m").agg(F.sum("words").alias("words")).collect()}
    names = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s or ""))
    size_of = {s: sum(n for p, n in patterns.items() if s in p) for s in names}
    # Words that several sources share count once in what is to be shared out.
    w = [weights[i % len(weights)] for i in range(len(names))]
    if all(len(p) == 1 for p in patterns):
        target = dict(zip(names, water_fill([size_of[s] for s in names], w), strict=True))
    else:
        total, all_words = sum(patterns.values()), max(1, sum(size_of.values()))
        filled = water_fill([size_of[s] for s in names], w)
        target = {s: t * total / all_words for s, t in zip(names, filled, strict=True)}
    flow = min_cost_flow(patterns, target, {p: p for p in patterns})

    spark = docs.sparkSession
    rows = []
    for p, n in patterns.items():
        used = sum(flow[p, r] for r in range(MAX_REPEATS))
        whole = min(MAX_REPEATS, int((used + 1e-6) // n)) if n else 0
        rows.append((list(p), whole, float(max(0.0, used - whole * n)), float(used), int(size_of[p[0]]), float(target[p[0]])))
    plan = spark.createDataFrame(rows, "_m array<string>, whole int, rest double, used double, source_size long, target double")

    # The range in which the cumulated words of a pattern pass its rest.
    upto = Window.partitionBy("_m").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    edge = ranges.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    keyed = lambda df: df.withColumn("_p", _pattern_key(F.col("_m")))
    plan = keyed(plan).drop("_m")
    edge = keyed(edge).join(F.broadcast(plan.select("_p", "rest")), "_p").where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    edge = edge.select("_p", F.col("_r").alias("edge"), "before")
    plan = plan.join(F.broadcast(edge), "_p", "left")

    chosen = keyed(sized).drop("_m").join(F.broadcast(plan), "_p")
    inside = F.col("_r") == F.col("edge")
    one = chosen.where(inside)
    order = Window.partitionBy("_p", "_r").orderBy("_o", "_id", "_h").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("extra", F.col("before") + F.sum("size").over(order) <= F.col("rest"))
    rest = chosen.where(F.coalesce(~inside, F.lit(True))).withColumn("extra", F.coalesce(F.col("_r") < F.col("edge"), F.lit(True)) & (F.col("rest") > 0))
    # Read once for each filler and more: the windows behind it are sorted once.
    both = materialize(rest.unionByName(one).drop("edge", "before"))
    release(sized)
    # One more use of a few documents fills what the prefix leaves open: each time the largest
    # that fits the gap, at last the nearest in size.
    sums = both.groupBy("_p").agg(F.first("rest").alias("rest"), F.first("used").alias("used"), F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("got")).collect()
    left, slack = {r["_p"]: r["rest"] - r["got"] for r in sums}, {r["_p"]: tolerance * r["used"] for r in sums}
    picked: list[tuple] = []
    for k in range(FILLERS):
        gaps = F.broadcast(spark.createDataFrame([*left.items()], "_p string, gap double"))
        off = F.abs(F.col("size") - F.col("gap"))
        open_ = both.where((F.col("size") > 0) & (F.col("whole") + F.col("extra").cast("int") < MAX_REPEATS)).join(gaps, "_p").where(off < F.col("gap") if k == FILLERS - 1 else F.col("size") <= F.col("gap"))
        open_ = open_.join(F.broadcast(spark.createDataFrame(picked, "_p string, _o string, _h long")), ["_p", "_o", "_h"], "left_anti")
        found = open_.groupBy("_p").agg(F.min(F.struct(off.alias("off"), "_o", "_id", "_h", "size")).alias("f")).collect()
        picked += [(r["_p"], r["f"]["_o"], r["f"]["_h"]) for r in found]
        left |= {r["_p"]: left[r["_p"]] - r["f"]["size"] for r in found}
    wide = {p: g for p, g in left.items() if abs(g) > slack[p]}
    for r in found:  # the last one, which may be too large, is chosen anew
        if wide.get(r["_p"], 0) < 0:
            picked.remove((r["_p"], r["f"]["_o"], r["f"]["_h"]))
            wide[r["_p"]] += r["f"]["size"]
    more = F.broadcast(spark.createDataFrame(picked, "_p string, _o string, _h long").distinct().withColumn("filler", F.lit(True)))
    if wide:
        more = more.unionByName(_go_on(both.join(more, ["_p", "_o", "_h"], "left_anti"), wide, slack).withColumn("filler", F.lit(True)))
    final = both.join(more, ["_p", "_o", "_h"], "left")
    more = F.col("extra").cast("int") + F.coalesce("filler", F.lit(False)).cast("int")
    final = final.withColumn("repeats", F.when(F.col("size") > 0, F.col("whole") + more).otherwise(F.lit(0)))
    return final.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("repeats") * F.col("size")).cast("long").alias("taken"), "repeats", F.col("_h").alias("text_hash"))


def _go_on(rows: DataFrame, gaps: dict[str, float], slack: dict[str, float]) -> DataFrame:
    """(_p, _o, _h) of documents to use once more: a prefix of those that fit the gap, again and again until none does; at last the nearest in size."""
    spark, key = rows.sparkSession, ["_p", "_o", "_h"]
    table = lambda g: F.broadcast(spark.createDataFrame([*g.items()], "_p string, gap double"))
    # Rows that repeat id and text are used together.
    free = rows.join(table(gaps), "_p").where("size > 0").groupBy(*key, "_r").agg(F.sum("size").alias("size"), F.max(F.col("whole") + F.col("extra").cast("int")).alias("uses"))
    free = fit = materialize(free.where(F.col("uses") < MAX_REPEATS).drop("uses"))
    taken, over = spark.createDataFrame([], "_p string, _o string, _h long"), {}
    while gaps:
        fit = materialize(fit.join(table(gaps), "_p").where("size <= gap"))
        upto = Window.partitionBy("_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        ranges = fit.groupBy("_p", "_r", "gap").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
        ranges = F.broadcast(ranges.where("before <= gap").select("_p", "_r", "before", (F.col("before") + F.col("words") <= F.col("gap")).alias("all")))
        near = fit.join(ranges, ["_p", "_r"])
        order = Window.partitionBy("_p", "_r").orderBy("_o", "_h").rowsBetween(Window.unboundedPreceding, 0)
        edge = near.where("NOT all").withColumn("upto", F.col("before") + F.sum("size").over(order)).where("upto <= gap")
        new = materialize(near.where("all").select(*key, "size").unionByName(edge.select(*key, "size")))
        got = {r["_p"]: r["n"] for r in new.groupBy("_p").agg(F.sum("size").alias("n")).collect()}
        over |= {p: g for p, g in gaps.items() if p not in got}
        gaps = {p: gaps[p] - n for p, n in got.items() if gaps[p] - n > slack[p]}
        taken = taken.unionByName(new.select(*key))
        fit = fit.drop("gap").join(new.select(*key), key, "left_anti")
    if not over:
        return taken
    off = F.abs(F.col("size") - F.col("gap"))
    last = free.join(table(over), "_p").where(off < F.col("gap")).join(taken, key, "left_anti")
    last = last.groupBy("_p").agg(F.min(F.struct(off.alias("off"), "_o", "_h")).alias("f"))
    return taken.unionByName(last.select("_p", "f._o", "f._h"))


def _pattern_key(members: Column) -> Column:
    """A string for a set of sources, in which null and the empty name differ."""
    return F.to_json(F.struct(members.alias("m")), {"ignoreNullFields": "false"})
