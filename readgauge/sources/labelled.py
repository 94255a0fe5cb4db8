"""Labelled sentences: ``LABEL<TAB>sentence`` lines, abstracts parted by blank lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def line_ending_of(spark: SparkSession, path: str) -> str:
    """How the first line found below ``path`` ends; reads no more than that."""
    first = spark.read.option("lineSep", "\n").text(path).first()
    return "\r\n" if first and first["value"].endswith("\r") else "\n"


def read_labelled_groups(spark: SparkSession, path: str, line_ending: str | None = None,
                         on_malformed: str = "error") -> DataFrame:
    """``(abstract_id, pos, label, sentence)``, ``pos`` counting from 0 in each abstract.

    The blank line is the record separator, so large files still split; how lines
    end is seen from the first one unless given, and files that end them otherwise
    are read rightly but whole. The id comes from the ``###`` line; an abstract
    without it is told apart by its file and place, so that equal abstracts stay
    apart. Lines without a tab are ignored; a line with several tabs is an error,
    or with ``on_malformed='drop'`` left out.
    """
    if on_malformed not in ("error", "drop"):
        raise ValueError(f"on_malformed must be 'error' or 'drop', not {on_malformed!r}")
    line_ending = line_ending or line_ending_of(spark, path)
    records = spark.read.option("lineSep", line_ending * 2).text(path).select(
        "value", F.concat_ws("-", F.lit("at"), F.md5("_metadata.file_path"), F.col("_metadata.file_block_start").cast("string"),
                             F.monotonically_increasing_id().cast("string")).alias("place"))
    # three or more line ends in a row leave blanks at the edges, which carry no tab
    abstracts = records.select("place", F.posexplode(F.split("value", r"\n[ \t\r]*\n")).alias("part", "abstract"))
    lines = abstracts.filter(F.contains("abstract", F.lit("\t"))).select(
        F.coalesce(
            F.nullif(F.regexp_extract("abstract", r"(?m)^###[ ]*([^\s]+)", 1), F.lit("")), F.concat_ws("-", "place", "part")
        ).alias("abstract_id"),
        F.posexplode(
            F.filter(
                F.transform(F.split("abstract", "\n"), lambda line: F.btrim(line, F.lit(" \t\r"))),
                lambda line: F.contains(line, F.lit("\t")),
            )
        ).alias("pos", "line"),
    )
    fields = lines.withColumn("f", F.split("line", "\t"))
    if on_malformed == "drop":
        fields = fields.filter(F.size("f") == 2)
    else:
        bad = F.raise_error(F.concat(F.lit("malformed line: "), F.col("line")))
        fields = fields.withColumn("f", F.when(F.size("f") == 2, F.col("f")).otherwise(bad))
    return fields.select("abstract_id", "pos", F.col("f")[0].alias("label"), F.col("f")[1].alias("sentence"))


def _flat_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.btrim("value", F.lit(" \r\n\t")).alias("line"))
    return lines.filter((F.col("line") != "") & ~F.startswith("line", F.lit("###"))).withColumn(
        "f", F.split("line", "\t")
    )


def read_labelled_flat(spark: SparkSession, path: str) -> DataFrame:
    """``(text, label)`` of every well-formed line."""
    return _flat_lines(spark, path).filter(F.size("f") == 2).select(
        F.col("f")[1].alias("text"), F.col("f")[0].alias("label")
    )


def read_labelled_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines ``read_labelled_flat`` leaves out as malformed."""
    return _flat_lines(spark, path).filter(F.size("f") != 2).select("line")


def write_labelled_groups(df: DataFrame, path: str, group_id: str, labelled: list[tuple[str, str]],
                          mode: str = "errorifexists") -> None:
    """One abstract per row of ``df``: ``labelled`` lists (label, sentence column) in order.

    Line breaks and tabs inside a sentence become spaces; empty sentences are left out.
    """
    def line(label: str, column: str):
        flat = F.trim(F.regexp_replace(column, r"[\t\r\n]+", " "))
        return F.when(flat != "", F.concat(F.lit(label + "\t"), flat))

    head = F.concat(F.lit("###"), F.col(group_id))
    body = F.concat_ws("\n", head, *[line(label, column) for label, column in labelled])
    df.select(body.alias("value")).write.mode(mode).option("lineSep", "\n\n").text(path)
