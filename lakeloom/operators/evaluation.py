"""How well scores separate labelled rows: threshold curves and the area under the ROC curve.

Both rest on counts of positives and negatives by distinct score, summed along
ranges of (keys, score): a key with any number of scores spreads over tasks.
Counts are whole numbers, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranges


def _counts(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """By distinct score: positives and negatives, and how many score at least as much (`_tp`, `_fp`), of how many (`_p`, `_n`)."""
    known = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).select(*keys, F.col(score).alias(score), F.col(positive).cast("boolean").alias("_y"))
    counts = known.groupBy(*keys, score).agg(F.count_if("_y").alias("_pos"), F.count_if(~F.col("_y")).alias("_neg"))
    below = ranges.running_sums(counts, keys, [score], {"_tpb": F.col("_pos"), "_fpb": F.col("_neg")}, {"_tpb": "_p", "_fpb": "_n"})
    return below.withColumns({"_tp": F.col("_p") - F.col("_tpb") + F.col("_pos"), "_fp": F.col("_n") - F.col("_fpb") + F.col("_neg")}).drop("_tpb", "_fpb")


def threshold_curve(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """For each distinct score as threshold (a row is called positive from it on): tp, fp, fn, tn, precision, recall, f1.

    Rows with a null score or label take no part. Without positives recall and
    f1 are null. A null key is a group; an empty table gives no rows. NaN is
    the greatest score.
    """
    c = _counts(df, keys, score, positive)
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_p") - F.col("_tp")
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    some = F.col("_p") > 0
    return c.select(*keys, score, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (F.col("_n") - fp).alias("tn"), ratio(tp, tp + fp).alias("precision"), F.when(some, ratio(tp, F.col("_p"))).alias("recall"), F.when(some, ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def best_thresholds(df: DataFrame, keys: list[str], score: str, positive: str, by: Column | str = "f1") -> DataFrame:
    """The row of `threshold_curve` with the greatest `by` for each group, of equal ones that of the greatest score."""
    curve = threshold_curve(df, keys, score, positive).withColumn("_by", F.col(by) if isinstance(by, str) else by).where("_by is not null")
    rest = [c for c in curve.columns if c not in (*keys, "_by")]
    return curve.groupBy(*keys).agg(F.max(F.struct("_by", score, F.struct(*rest).alias("_row"))).alias("_top")).select(*keys, "_top._row.*")


def auc(df: DataFrame, keys: list[str], score: str, positive: str, name: str = "auc") -> DataFrame:
    """Area under the ROC curve by rank statistics: the share of pairs in which the positive scores higher, equal scores for half.

    Columns: keys, positives, negatives, `name` (null where either is missing). Nulls as in `threshold_curve`.
    """
    c = _counts(df, keys, score, positive)
    exact = lambda x: x.cast("decimal(19,0)")
    # Twice the pairs, so that halves stay whole.
    won = F.sum(exact(F.col("_pos")) * exact(2 * (F.col("_n") - F.col("_fp")) + F.col("_neg")))
    out = c.groupBy(*keys).agg(F.max("_p").alias("positives"), F.max("_n").alias("negatives"), won.cast("double").alias("_won"))
    return out.select(*keys, "positives", "negatives", F.try_divide("_won", 2 * F.col("positives").cast("double") * F.col("negatives").cast("double")).alias(name))
