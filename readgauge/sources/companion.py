"""Abstracts kept in a text file beside each article, and dataset preparation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEW_LINE_MARK = "#@NEW_LINE#@#"  # fixed value: line-break mark inside companion files


def line_after_marker(text: Column, marker: str = "Abstract", drop: str = NEW_LINE_MARK) -> Column:
    """The trimmed line below the first line that contains ``marker``, else ''.

    ``drop`` is removed from it. Text is taken with one search, not line by line.
    """
    pattern = rf"(?:^|\n)[^\n]*?\Q{marker}\E[^\n]*\n([^\n]*)"
    found = F.btrim(F.regexp_extract(text, pattern, 1), F.lit(" \t\r\n"))
    return F.replace(found, F.lit(drop), F.lit(""))


def read_companions(spark: SparkSession, path: str) -> DataFrame:
    """``(file, body)`` for each text file under ``path``; ``file`` is the path below it."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", path).rstrip("/") + "/"
    below = F.substring_index("_metadata.file_path", root, -1)
    return files.select(below.alias("file"), F.col("value").alias("body"))


def lookup_companion(articles: DataFrame, companions: DataFrame, path_col: str, out: str = "companion",
                     file_col: str = "file", value_col: str = "body") -> DataFrame:
    """Join each article's companion on its path with ``.xml`` read as ``.txt``; '' if there is none."""
    right = companions.select(F.col(file_col).alias("_file"), F.col(value_col).alias("_value"))
    key = F.replace(F.col(path_col), F.lit(".xml"), F.lit(".txt"))
    joined = articles.withColumn("_key", key).join(right, F.col("_key") == F.col("_file"), "left")
    return joined.select(*[F.col(c) for c in articles.columns], F.coalesce("_value", F.lit("")).alias(out))


def keep_longer_than(df: DataFrame, text_col: str, n: int = 100, length_col: str | None = None) -> DataFrame:
    """Rows whose text has more than ``n`` characters.

    With ``length_col``, a stored length, the filter reaches the file reader.
    """
    length = F.col(length_col) if length_col else F.length(text_col)
    return df.filter(length > n)


def prepare_dataset(articles: DataFrame, companions: DataFrame, path_col: str = "Full_Paper_XML",
                    keep=("id", "Paper_Journal", "Eureka_Text_Simplified"), min_chars: int = 100) -> DataFrame:
    """Attach each article's abstract and keep those with more than ``min_chars`` characters."""
    slim = companions.select("file", line_after_marker(F.col("body")).alias("body"))
    found = lookup_companion(articles.select(*keep, path_col), slim, path_col, "Paper_abstract")
    return keep_longer_than(found, "Paper_abstract", min_chars).select(*keep, "Paper_abstract")
