"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to delete the shuffle files of a query as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set: a temporary one, removed at exit, if Spark is local; else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lakeloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return base


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lakeloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}"


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; DataFrames that still read them end with it."""
    _delete(spark, _own_dir(spark))


def release(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote and that nothing reads any more; other DataFrames are left alone."""
    for t in tables:
        if where := t.__dict__.get("scratch_path"):
            _delete(t.sparkSession, where)


class _Open(threading.local):
    """Tables written within the scopes that a thread has open."""

    def __init__(self):
        self.scopes: list[list[DataFrame]] = []


_open, _lock, _writers = _Open(), threading.Lock(), {}


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Delete the tables that this thread writes inside, at the end; those taken out of the list stay."""
    tables: list[DataFrame] = []
    _open.scopes.append(tables)
    try:
        yield tables
    finally:
        _open.scopes.pop()
        release(*tables)


@contextmanager
def _cleaning_up(spark: SparkSession) -> Iterator[None]:
    """CLEAN_UP is on while any thread writes a table in this session; the last one puts back what was set."""
    key = id(spark._jsparkSession)
    with _lock:
        n, before = _writers.get(key, (0, None))
        before = before if n else spark.conf.get(CLEAN_UP, None)
        _writers[key] = n + 1, before
        spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writers.pop(key)
            if n > 1:
                _writers[key] = n - 1, before
            elif before is None:
                spark.conf.unset(CLEAN_UP)
            else:
                spark.conf.set(CLEAN_UP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind it are deleted with the write's end: what follows reads the table.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession)
    with _cleaning_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    if _open.scopes:
        _open.scopes[-1].append(table)
    return table
