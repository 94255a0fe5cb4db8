"""The test tables seen as this package's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import stack_sections
from ..session import scratch_path
from ..sources.articles import pairs_from
from ..sources.tables import is_small, read_parquet


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", spread)


def documents(spark: SparkSession, sf_dir: str, lang: str | None = None) -> DataFrame:
    df = table(spark, sf_dir, "documents", spread=True)
    return df.filter(F.col("lang") == lang) if lang else df


def documents_once(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``columns`` of the documents for plans that read them several times: a small input is dealt out once and written."""
    df = documents(spark, sf_dir).select(*columns)
    if not is_small(spark, f"{sf_dir}/documents.parquet"):
        return df
    path = scratch_path(spark, "documents")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question and the answer right after it, as ``(doc_id, abstract, summary)``.

    Turns meet on (conversation, turn), which is unique, so a conversation of
    any length spreads over all tasks and no text is gathered. A question
    without an answer has the summary ''.
    """
    turns = table(spark, sf_dir, "conversations", spread=True)
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("abstract"))
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("summary")
    )
    joined = asked.join(answered, ["conv_id", "turn"], "left").withColumn(
        "doc_id", F.concat_ws("-", "conv_id", "turn")
    )
    return pairs_from(joined, "doc_id", "abstract", "summary")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with one row per text: ``(doc_id, section, text)``."""
    return stack_sections(pairs(spark, sf_dir))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled sentences: the role is the label and the turn the position."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("abstract_id"), F.col("turn").alias("pos"), F.col("role").alias("label"),
        F.col("text").alias("sentence"),
    )
