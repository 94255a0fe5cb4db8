"""Experiment records as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RESULT = T.StructType([
    T.StructField("feature_combination", T.ArrayType(T.StringType())),
    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("feature_importances", T.ArrayType(T.DoubleType())),
    T.StructField("model_coefficients", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("model_intercept", T.ArrayType(T.DoubleType())),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("class_labels", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])


def write_results(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    records.write.mode(mode).json(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType = RESULT) -> DataFrame:
    return spark.read.schema(schema).json(path)
