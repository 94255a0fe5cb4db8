"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: list[list[Callable[[], None]]] = []


@contextmanager
def noted():
    """Collects what removes the tables that are written meanwhile; see ``remove``."""
    _MADE.append([])
    try:
        yield _MADE[-1]
    finally:
        _MADE.pop()


def _note(spark: SparkSession, path: str, table_name: str | None = None) -> None:
    def drop() -> None:
        if table_name:
            spark.sql(f"DROP TABLE IF EXISTS {table_name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    for made in _MADE:
        made.append(drop)


def remove(made: list[Callable[[], None]]) -> None:
    """Removes intermediate tables, once nothing that reads them will run again."""
    while made:
        made.pop()()


# Rows of a few MB would wait for a hundred of their like before a page is closed, and for 128 MB before a row group is.
PARQUET = {"compression": "zstd", "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1",
           "parquet.block.size": str(32 << 20)}


def thrifty(function):
    """A function of batches whose worker gives its memory back when it is done, for workers outlive their tasks."""
    def run(batches):
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)
    return run


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None):
    """Fewer rows in a batch to or from a worker, for rows that are large; the session's setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """The rows as a table in shared storage: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    _note(df.sparkSession, path)
    with arrow_rows(df.sparkSession, batch_rows):
        df.write.options(**PARQUET).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(column) -> F.Column:
    """A-Z to a-z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def bucketed(df: DataFrame, name: str, least: int, by: str = "pid") -> DataFrame:
    """Written once, bucketed by ``pid`` or another column: joins on it and more columns don't shuffle this side.

    ``pid`` is the writing task's number, so each task writes one file. Joins keep the buckets only with the setting below,
    which stays on for the session, and with as many buckets as there are shuffle partitions.
    """
    buckets = max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark, table_name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    _note(spark, path, table_name)
    df.write.options(**PARQUET).bucketBy(buckets, by).option("path", path).saveAsTable(table_name)
    return spark.table(table_name)
