"""Joins that Spark has no operator for, as plans of built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], tolerance: Column | None = None, spread: bool = False) -> DataFrame:
    """Give each left row the values of the latest right row of its keys, not after it.

    Both sides are united and carried forward in one window over the keys, so
    the cost is one shuffle and one sort, never a product of both sides. At
    equal times right rows come first; of several right rows with one time the
    one with the greatest values wins. Left rows without a match keep nulls,
    as do those whose match is older than `tolerance` (an interval). Keys and
    times that are null never match.

    The window holds a key's rows in one task. With `spread` they are dealt by
    ranges of key and time, and the last value of each range is carried to the
    next: for keys that hold a large part of all rows.
    """
    row = [F.col(c).alias(c) for c in left.columns]
    value = F.struct(F.col(right_time).alias("_t"), *values)
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_time).alias("_at"), F.lit(1).alias("_side"), F.struct(*row).alias("_row"))
    b = right.where(F.col(right_time).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_time).alias("_at"), F.lit(0).alias("_side"), value.alias("_value"))
    both = a.unionByName(b, allowMissingColumns=True)
    by, along = [f"_k{i}" for i in range(len(keys))], ["_at", "_side", "_value"]
    if spread:
        found = ranges.last_values(both, by, along, "_value")
    else:
        order = Window.partitionBy(*by).orderBy(*[F.col(c).asc_nulls_first() for c in along]).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_value", F.last("_value", ignorenulls=True).over(order))
    found = found.where("_side = 1")
    known = F.col("_at").isNotNull()
    for i in range(len(keys)):
        known &= F.col(f"_k{i}").isNotNull()
    if tolerance is not None:
        known &= F.col("_value._t") >= F.col("_at") - tolerance
    return found.select("_row.*", *[F.when(known, F.col(f"_value.{v}")).alias(v) for v in values])


#: Buckets that an interval may cross before it moves to buckets STEP times as wide.
STEP = 64


def interval_join(left: DataFrame, right: DataFrame, point: str, start: str, end: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs with start <= point <= end of numeric columns, as an equi-join on buckets.

    Each interval is copied to the buckets of `width` that it crosses, so
    `width` should be near its usual length; an interval of more than STEP
    widths takes buckets STEP times as wide, and so on, so none is copied more
    than STEP + 1 times. A point lies in one bucket of each width in use, so no
    pair is met twice.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log(float(STEP), F.greatest((F.col(end) - F.col(start)) / width, F.lit(1.0))) - 1)).cast("int")
    valid = right.where(F.col(start) <= F.col(end)).withColumn("_l", level)
    most = valid.agg(F.max("_l").alias("m")).first()["m"] or 0
    bucket = lambda c: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(float(STEP)), F.col("_l"))))
    cover = valid.withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end))))
    levels = F.explode(F.sequence(F.lit(0), F.lit(most))) if most else F.lit(0)
    on = ["_b", "_l", *(keys or [])]
    return left.withColumn("_l", levels).withColumn("_b", bucket(point)).join(cover, on).where((F.col(start) <= F.col(point)) & (F.col(point) <= F.col(end))).drop("_b", "_l")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int, how: str = "inner", share: float = 0.001) -> DataFrame:
    """Join on keys of which a few hold a large part of the left rows.

    Only keys with more than `share` of the left rows, so 1 / share keys at
    most, are salted: their right rows are copied to every salt. That bound is
    why they may be broadcast.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the side that is copied can't be the one that is kept")
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("t")).first()["t"] or 0
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    hot = F.broadcast(counts.where((F.col("_n") > share * total) & known).select(*keys, F.lit(True).alias("_hot")))
    pick = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    # Null keys match nothing: they may go anywhere.
    spread = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot") | ~known, pick).otherwise(0)).drop("_hot")
    copies = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), salts - 1).otherwise(0)))).drop("_hot")
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def not_in(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """SQL's NOT IN: nothing passes if the right side holds a null, everything if it is empty; else null never passes."""
    has = right.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(right_col).isNull()).alias("nulls")).first()
    if has["nulls"]:
        return left.where(F.lit(False))
    if not has["n"]:
        return left
    values = right.select(F.col(right_col).alias("_v"))
    return left.where(F.col(left_col).isNotNull()).join(values, F.col(left_col) == F.col("_v"), "left_anti")
