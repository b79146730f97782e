"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.scratch import materialize as materialize
from lakeloom.sources.scratch import release as release

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and pass it to `body`, which may use it in nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
