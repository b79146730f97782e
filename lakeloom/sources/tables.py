"""Readers and writers for the formats that Spark has built in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Formats that are read and written with a schema; text and binary files have their own fixed one.
FORMATS = ("parquet", "orc", "csv", "json", "xml", "text", "binaryFile")
#: Rows of a file at most where one task reads a file as a whole.
WHOLE_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, or of any folder that holds `name`.parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """Read files of a format. CSV, JSON and XML need a schema: inferring one reads everything twice and guesses types."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    if fmt in ("csv", "json", "xml") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {"rowTag": "row"} if fmt == "xml" else {}) | options)
    return (reader.schema(schema) if schema is not None and fmt not in ("text", "binaryFile") else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists", **options: str) -> None:
    """Write files of a format; `partition_by` columns become folders that later filters prune.

    XML files are read whole, each by one task, so they get WHOLE_ROWS rows at
    most; `maxRecordsPerFile` sets another number.
    """
    if fmt not in FORMATS or fmt == "binaryFile":
        raise ValueError(f"can't write {fmt}")
    writer = df.write.format(fmt).mode(mode).options(**({"header": "true"} if fmt == "csv" else {"rowTag": "row", "maxRecordsPerFile": str(WHOLE_ROWS)} if fmt == "xml" else {}) | options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, table: str, keys: tuple[str, ...], buckets: int, mode: str = "errorifexists", path: str | None = None) -> None:
    """Save a table bucketed and sorted by join keys, so that joins of two such tables need no shuffle; at `path`, or in the warehouse.

    Rows are dealt by bucket first: each bucket becomes one file, not one of every task.
    """
    writer = df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)
