"""Similarity of neighbours in ordered sequences of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import cosine, ratio


def with_next(df: DataFrame, sequence: str, position: str, value: str, out: str = "next",
              stretch: int = 100_000) -> DataFrame:
    """Add the ``value`` of the following position of the same sequence, null at its end.

    Positions are unique integers within a sequence. A sequence is cut into
    stretches of ``stretch`` positions that are ordered independently, so a
    sequence with a large part of all rows still spreads over many tasks. Each
    stretch also gets a copy of the first row after it, for its last row to see.
    """
    cut = df.withColumns({"_stretch": F.floor(F.col(position) / stretch), "_copy": F.lit(False)})
    heads = cut.groupBy(sequence, "_stretch").agg(
        F.min_by(F.struct(position, value), position).alias("_head")
    )
    # one row per stretch: a hundred-thousandth of the positions
    in_order = Window.partitionBy(sequence).orderBy("_stretch")
    copies = heads.select(
        sequence, F.lag("_stretch").over(in_order).alias("_stretch"), "_head.*", F.lit(True).alias("_copy")
    ).filter("_stretch IS NOT NULL")
    inside = Window.partitionBy(sequence, "_stretch").orderBy(position)
    followed = cut.unionByName(copies, allowMissingColumns=True).withColumn(
        "_next", F.lead(F.struct(F.col(value).alias("v"))).over(inside)
    )
    return followed.filter(~F.col("_copy")).select(*df.columns, F.col("_next")["v"].alias(out))


def adjacent_cosine(df: DataFrame, sequence: str, position: str, vector: str, out: str = "adjacent_cosine",
                    stretch: int = 100_000) -> DataFrame:
    """``(sequence, adjacent_cosine)``: mean cosine of neighbours, 1.0 for a single vector."""
    followed = with_next(df.select(sequence, position, vector), sequence, position, vector, "_following", stretch)
    pair = F.when(F.col("_following").isNotNull(), cosine(F.col(vector), F.col("_following")))
    return followed.groupBy(sequence).agg(
        ratio(F.coalesce(F.sum(pair), F.lit(0.0)), F.count(pair), empty=1.0).alias(out)
    )
