"""Parquet inputs and feature tables."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPREAD_BELOW_BYTES = 1 << 30


def read_parquet(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """Read parquet; ``spread`` evens out small inputs for per-row heavy work.

    A small input may sit in one row group and so in one task. Only below
    ``SPREAD_BELOW_BYTES`` are its rows dealt out over the cores; larger inputs
    keep their file splits and are not shuffled.
    """
    df = spark.read.parquet(path)
    if spread and is_small(spark, path):
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df


def is_small(spark: SparkSession, path: str) -> bool:
    """Whether the rows below ``path`` are dealt out when they are spread."""
    return input_bytes(spark, path) < SPREAD_BELOW_BYTES


def input_bytes(spark: SparkSession, path: str) -> int:
    """Total file size under ``path``; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def read_feature_csv(spark: SparkSession, path: str, schema=None, key: str = "doc_id",
                     check_duplicates: bool = True) -> DataFrame:
    """A feature table with header. The key column must exist; duplicates only warn."""
    reader = spark.read.option("header", True).option("escape", '"')
    df = reader.csv(path, schema=schema) if schema else reader.csv(path, inferSchema=True)
    if key not in df.columns:
        raise ValueError(f"{path} has no column {key!r}")
    if check_duplicates and not duplicate_keys(df, key).isEmpty():
        warnings.warn(f"{path} has repeated values of {key!r}", stacklevel=2)
    return df


def duplicate_keys(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; an empty frame still leaves a file with its header."""
    df.write.mode(mode).options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
