"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b of type long); component is the smallest node.

    Each round rewrites the edges so that every node points nearer to the
    smallest one of its component; minima are combined before the shuffle, and
    joins on a hub node are plain equi-joins that adaptive execution can split.
    The edges of a round are written to the shared folder, so a lost executor
    costs at most one round; those of the round before are deleted. Loops are ignored; no edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialize(pairs)
    mark = _mark(pairs)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, pairs = pairs, materialize(small.where("u <> v").distinct())
        release(before)
        new = _mark(pairs)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    ends = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return ends.unionByName(ends.select("component").distinct().select(F.col("component").alias("node"), "component"))


def _mark(pairs: DataFrame) -> tuple:
    """Number and check sum of the edges: equal ones mean that nothing changed."""
    r = pairs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return r["n"], r["s"]
