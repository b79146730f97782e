"""Registered queries over tables that are first written: formats, partitioned and bucketed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources import tables
from lakeloom.sources.scratch import new_path
from lakeloom.sources.tables import read_table

from .registry import register

_CUSTOMERS = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _round_trip(fmt: str):
    @register(f"format_{fmt}", _CUSTOMERS)
    def query(spark: SparkSession, sf: str) -> DataFrame:
        c, path = read_table(spark, sf, "customer"), new_path(spark)
        tables.write(c, path, fmt)
        return tables.read(spark, path, fmt, c.schema).select(*c.columns)

    query.__doc__ = f"Customers written as {fmt} and read back with their schema."
    return query


format_csv, format_json, format_xml, format_orc = map(_round_trip, ("csv", "json", "xml", "orc"))


@register("format_text", "SELECT c_name AS value, length(c_name)::BIGINT AS n FROM customer")
def format_text(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark)
    tables.write(read_table(spark, sf, "customer").select(F.col("c_name").alias("value")), path, "text")
    return tables.read(spark, path, "text").select("value", F.length("value").cast("long").alias("n"))


@register("format_binary", "SELECT sum(strlen(c_name) + 1)::BIGINT AS bytes FROM customer")
def format_binary(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of the text files, each line ending included; a file is one value, so its rows are bounded."""
    path = new_path(spark)
    tables.write(read_table(spark, sf, "customer").select(F.col("c_name").alias("value")), path, "text", maxRecordsPerFile=str(tables.WHOLE_ROWS))
    return tables.read(spark, path, "binaryFile", pathGlobFilter="*.txt").agg(F.sum(F.octet_length("content")).alias("bytes"))


def by_year(spark: SparkSession, sf: str) -> DataFrame:
    """`lineitem` as a table in a folder for each year."""
    path = new_path(spark)
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", F.year("l_shipdate").alias("y"))
    # A folder's rows come from few tasks, so that it doesn't get a file from each.
    tables.write(rows.repartition("y", F.pmod(F.xxhash64("l_orderkey"), F.lit(4))), path, partition_by=("y",))
    return spark.read.parquet(path)


@register("static_pruning", "SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE year(l_shipdate) = 1997")
def static_pruning(spark: SparkSession, sf: str) -> DataFrame:
    """A filter on the folder column reads that year's folder only."""
    return by_year(spark, sf).where("y = 1997").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@register("dynamic_pruning", "SELECT year(l_shipdate)::INTEGER AS y, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE year(l_shipdate) IN (SELECT year(o_orderdate) FROM orders WHERE o_orderkey < 3) GROUP BY ALL")
def dynamic_pruning(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the years of some orders: which folders are read is known when these have been."""
    years = read_table(spark, sf, "orders").where("o_orderkey < 3").select(F.year("o_orderdate").alias("y")).distinct()
    return by_year(spark, sf).join(years, "y").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


BUCKETS = 16


@register("bucketed_join", "SELECT o_orderkey, o_totalprice, sum(l_quantity) AS quantity, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def bucketed_join(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables bucketed by the order: neither the join nor the sum by order needs a shuffle."""
    names = []
    for t, columns, key in (("orders", ["o_orderkey", "o_totalprice"], "o_orderkey"), ("lineitem", ["l_orderkey", "l_quantity"], "l_orderkey")):
        names.append(f"lakeloom_{t}_{uuid.uuid4().hex}")
        tables.write_bucketed(read_table(spark, sf, t).select(*columns), names[-1], (key,), BUCKETS, path=new_path(spark))
    o, li = map(spark.table, names)
    j = o.join(li.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderkey").agg(F.first("o_totalprice").alias("o_totalprice"), F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))
