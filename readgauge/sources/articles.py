"""Paired texts: JSON articles and CSV pairs.

Every reader returns the canonical pairs frame ``(doc_id, abstract, summary)``
in which no text is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quoted import read_quoted_csv

ARTICLE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("abstract", T.ArrayType(T.StringType())),
    T.StructField("summary", T.ArrayType(T.StringType())),
])

ARRAY_FILE_LIMIT = 512 << 20


def _joined(parts: Column) -> Column:
    return F.coalesce(F.array_join(parts, " "), F.lit(""))


def _with_required_id(df: DataFrame) -> DataFrame:
    missing = F.raise_error(F.lit("an article has no id; positions exist only in array files"))
    return df.select(
        F.coalesce("id", missing).alias("doc_id"),
        _joined(F.col("abstract")).alias("abstract"),
        _joined(F.col("summary")).alias("summary"),
    )


def explode_articles(df: DataFrame, json: str, *keep: str) -> DataFrame:
    """One row per article of a JSON array in column ``json``.

    An article without an id is called ``doc_{n}`` after its place in the array,
    counted from 1. A text that is not such an array, cut off or with a string in
    place of a list, is an error; a blank one has no articles.
    """
    given = F.nullif(F.btrim(json, F.lit(" \t\r\n")), F.lit(""))
    articles = F.from_json(given, T.ArrayType(ARTICLE), {"mode": "FAILFAST"})
    not_parsed = F.raise_error(F.concat(F.lit("not an array of articles: "), F.left(given, F.lit(80))))
    checked = F.when(given.isNotNull() & articles.isNull(), not_parsed).otherwise(articles)
    parsed = df.select(*keep, F.posexplode(checked).alias("pos", "a"))
    return parsed.select(
        *keep,
        F.coalesce("a.id", F.concat(F.lit("doc_"), F.col("pos") + 1)).alias("doc_id"),
        _joined(F.col("a.abstract")).alias("abstract"),
        _joined(F.col("a.summary")).alias("summary"),
    )


def read_articles(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Articles ``{id, abstract: [str], summary: [str]}``.

    * ``lines``: one object per line. Splittable, so the layout for large data.
    * ``array``: each file holds one array; ids may be missing. A file is one
      record here, so files over ``ARRAY_FILE_LIMIT`` are refused.
    * ``array_with_ids``: each file holds one array of any size, parsed as a
      stream; ids are required.

    JSON that is cut off, garbled or of another shape is an error in every layout.
    """
    reader = spark.read.schema(ARTICLE).option("mode", "FAILFAST")
    if layout == "lines":
        return _with_required_id(reader.json(path))
    if layout == "array_with_ids":
        return _with_required_id(reader.option("multiLine", True).json(path))
    if layout == "array":
        files = spark.read.text(path, wholetext=True)
        too_big = F.raise_error(F.concat(F.col("_metadata.file_path"), F.lit(
            ": too large to number its articles; give them ids and use layout='array_with_ids'")))
        size = F.col("_metadata.file_size")
        checked = files.select(F.when(size > ARRAY_FILE_LIMIT, too_big).otherwise(F.col("value")).alias("json"))
        return explode_articles(checked, "json")
    raise ValueError(f"unknown layout {layout!r}")


def write_articles(pairs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pairs as article lines, each text as a one-element list."""
    pairs.select(
        F.col("doc_id").alias("id"), F.array("abstract").alias("abstract"), F.array("summary").alias("summary")
    ).write.mode(mode).json(path)


def read_pairs_csv(spark: SparkSession, path: str, id_col: str = "doc_id", abstract_col: str = "abs_text",
                   summary_col: str = "pls_text") -> DataFrame:
    """Pairs from CSV with quoted line breaks, each file read by as many tasks as it has blocks. The three columns must exist."""
    return pairs_from(read_quoted_csv(spark, path), id_col, abstract_col, summary_col)


def pairs_from(df: DataFrame, id_col: str, abstract_col: str, summary_col: str) -> DataFrame:
    """The pairs frame from any table; a missing column is an error, a null text is ''."""
    missing = [c for c in (id_col, abstract_col, summary_col) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df.select(
        F.col(id_col).cast("string").alias("doc_id"),
        F.coalesce(F.col(abstract_col), F.lit("")).alias("abstract"),
        F.coalesce(F.col(summary_col), F.lit("")).alias("summary"),
    )
