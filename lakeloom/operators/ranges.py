"""Running values over groups of any size.

A window by a key sorts the key's rows in one task. Here rows are dealt by
ranges of (keys, order), so that a key with a third of all rows spreads over a
third of the tasks; each task handles its part of a group, and one row for each
group and range carries what lies before it. Range bounds come from a sample of
the rows, so they hold about equal numbers of rows whatever the values are.
Null keys are a group, as in groupBy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.scratch import materialize

PART = "_part"


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df` with the number of each row's range (`_part`), in the order of keys and `order`; written once, since bounds are sampled anew each time."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id()))


def same(names: list[str], prefix: str) -> Column:
    """Whether columns equal those named with the prefix, nulls too."""
    test = F.lit(True)
    for c in names:
        test = test & F.col(c).eqNullSafe(F.col(prefix + c))
    return test


def with_carried(rows: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside what `ends`, one row for each range and group, holds for them."""
    on = [PART, *keys]
    found = ends.withColumnsRenamed({c: f"_e_{c}" for c in on})
    return rows.join(found, same(on, "_e_")).drop(*[f"_e_{c}" for c in on])


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """`df` with sums over the rows of its group up to each row in `order` (nulls first), itself included.

    `order` has to tell the rows of a group apart: rows that tie are summed in
    any order, one of several ranges may not. `totals` names, for some of the
    sums, a column with the sum over the whole group.
    """
    rows = ranged(df, keys, order)
    parts = rows.groupBy(PART, *keys).agg(*[F.sum(x).alias(f"_s_{c}") for c, x in sums.items()])
    # As many rows for a group as it has ranges.
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums]
    whole = [F.sum(f"_s_{c}").over(group).alias(name) for c, name in (totals or {}).items()]
    ends = parts.select(PART, *keys, *carried, *whole)
    local = Window.partitionBy(PART, *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    out = with_carried(rows, ends, keys)
    out = out.withColumns({c: F.col(f"_b_{c}") + F.coalesce(F.sum(x).over(local), F.lit(0)) for c, x in sums.items()})
    return out.drop(PART, *[f"_b_{c}" for c in sums])


def last_values(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """`df` with `value` replaced by the last one that isn't null among the rows of its group up to each row in `order`."""
    rows = ranged(df, keys, order)
    ends = rows.where(F.col(value).isNotNull()).groupBy(PART, *keys).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    ranges = rows.select(PART, *keys).distinct()
    ends = ranges.join(ends.withColumnsRenamed({c: f"_e_{c}" for c in (PART, *keys)}), same([PART, *keys], "_e_"), "left").select(PART, *keys, "_last")
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(PART, *keys, F.last("_last", ignorenulls=True).over(before).alias("_last"))
    local = Window.partitionBy(PART, *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return with_carried(rows, ends, keys).withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(local), "_last")).drop(PART, "_last")
