"""Window forms that Spark's SQL has no syntax for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition over window functions holds (QUALIFY)."""
    return df.withColumn("_q", condition).where("_q").drop("_q")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, ties: bool = False) -> DataFrame:
    """The first k rows of each group; with `ties`, all rows that rank among them. Spark cuts groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return qualify(df, (F.rank() if ties else F.row_number()).over(w) <= k)


def over_groups(df: DataFrame, name: str, agg: Column, keys: list[str], order: str, before: int, after: int) -> DataFrame:
    """An aggregate over a GROUPS frame: peers by `order` count as one; a RANGE frame over their dense rank."""
    peers = Window.partitionBy(*keys).orderBy(order)
    frame = Window.partitionBy(*keys).orderBy("_peer").rangeBetween(-before, after)
    return df.withColumn("_peer", F.dense_rank().over(peers)).withColumn(name, agg.over(frame)).drop("_peer")


def sum_excluding_row(value: str, frame) -> Column:
    """Sum over a frame without the current row (EXCLUDE CURRENT ROW), null when nothing else is in it."""
    rest = F.count(value).over(frame) - F.col(value).isNotNull().cast("long")
    return F.when(rest > 0, F.sum(value).over(frame) - F.coalesce(F.col(value), F.lit(0)))


def sessions(df: DataFrame, keys: list[str], time: str, gap: str, name: str = "session_no") -> DataFrame:
    """Number the sessions of each key: a new one starts after a pause longer than `gap` (an interval)."""
    w = Window.partitionBy(*keys).orderBy(time)
    first = F.lag(time).over(w).isNull() | (F.col(time) > F.lag(time).over(w) + F.expr(f"interval {gap}"))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_new", first.cast("long")).withColumn(name, F.sum("_new").over(running)).drop("_new")


def sum_excluding_peers(value: str, keys: list[str], order: str, keep_row: bool = False) -> Column:
    """Sum over a whole partition without the row's peers by `order` (EXCLUDE GROUP), or without all of them but the row itself (EXCLUDE TIES); null when nothing else is in it."""
    whole, peers = Window.partitionBy(*keys), Window.partitionBy(*keys, order)
    own, present = F.coalesce(F.col(value), F.lit(0)), F.col(value).isNotNull().cast("long")
    rest = F.count(value).over(whole) - F.count(value).over(peers) + (present if keep_row else 0)
    total = F.coalesce(F.sum(value).over(whole), F.lit(0)) - F.coalesce(F.sum(value).over(peers), F.lit(0))
    return F.when(rest > 0, total + own if keep_row else total)


def _value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for each distinct value of a group: `_v`, rows up to it (`_upto`) and of the group (`_n`), and its own (`_c`)."""
    counts = df.select(*keys, F.col(value).alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    return ranges.running_sums(counts, keys, ["_v"], {"_upto": F.col("_c")}, {"_upto": "_n"})


def percentile(df: DataFrame, keys: list[str], value: str, p: float | dict[str, float], name: str = "percentile") -> DataFrame:
    """Exact interpolated percentiles of each group without holding a group's values in one task.

    Counts of distinct values are summed along ranges of (keys, value), so
    neither a hot group nor an outlier fills a task. `p` is one share, or
    several by column name. Null values are left out, and so are groups without
    others; a null key is a group.
    """
    shares = p if isinstance(p, dict) else {name: p}
    counts = _value_counts(df.withColumn(value, F.col(value).cast("double")), keys, value)
    holds = lambda rank: F.max(F.when((F.col("_upto") - F.col("_c") <= rank) & (F.col("_upto") > rank), F.col("_v")))
    at = {c: F.lit(float(x)) * (F.col("_n") - 1) for c, x in shares.items()}
    ends = counts.groupBy(*keys).agg(F.max("_n").alias("_n"), *[f(holds(g(x)), c) for c, x in at.items() for f, g in ((lambda h, c: h.alias(f"_a_{c}"), F.floor), (lambda h, c: h.alias(f"_z_{c}"), F.ceil))])
    part = {c: x - F.floor(x) for c, x in at.items()}
    between = lambda c: F.when(part[c] == 0, F.col(f"_a_{c}")).otherwise(F.col(f"_a_{c}") + part[c] * (F.col(f"_z_{c}") - F.col(f"_a_{c}")))
    return ends.select(*keys, *[between(c).alias(c) for c in shares])


def discrete_percentile(df: DataFrame, keys: list[str], value: str, p: float | dict[str, float], name: str = "percentile") -> DataFrame:
    """The least value that a share of a group's rows doesn't exceed (PERCENTILE_DISC); spread and nulls as in `percentile`."""
    shares = p if isinstance(p, dict) else {name: p}
    counts = _value_counts(df, keys, value)
    return counts.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.lit(float(x)) * F.col("_n")), F.lit(1)), F.col("_v"))).alias(c) for c, x in shares.items()])
