"""Small tables whose size is checked before they are sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 10_000


def settled(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` computed now and marked for broadcast if it has at most ``limit`` rows.

    A larger one is returned as it is, for a shuffled join. Meant for tables with
    a row per group, which are small unless there are very many groups.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
