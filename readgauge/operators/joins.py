"""Merging feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_features(frames, key: str = "doc_id", unique_keys: bool = False) -> DataFrame:
    """Full outer join of all frames on ``key``; repeated keys multiply.

    A chain of full outer joins would shuffle the growing result again at every
    step. Here the distinct keys come first and each frame is joined to them from
    the left, which keeps their partitioning, so each frame is shuffled once.
    A null key is a key like any other and meets the null keys of other frames.

    ``unique_keys=True`` promises one row per key and frame, and instead stacks
    the frames and groups once; a broken promise is an error.
    """
    frames = _distinct_names(list(frames), key)
    if unique_keys:
        return _merge_by_grouping(frames, key)
    # structs compare their nulls as equal, and need no second shuffle for it
    keyed = [f.select(F.struct(key).alias("_key"), *[c for c in f.columns if c != key]) for f in frames]
    spine = reduce(DataFrame.union, [f.select("_key") for f in keyed]).distinct()
    merged = reduce(lambda left, right: left.join(right, "_key", "left"), keyed, spine)
    return merged.select(F.col("_key")[key].alias(key), *[c for c in merged.columns if c != "_key"])


def _distinct_names(frames: list[DataFrame], key: str) -> list[DataFrame]:
    """Rename columns that clash: ``_x`` on the left, ``_y`` on the right."""
    done: list[DataFrame] = []
    for right in frames:
        taken = {c for f in done for c in f.columns} - {key}
        clashes = taken & (set(right.columns) - {key})
        if clashes:
            done = [_suffixed(f, clashes, "_x") for f in done]
            right = _suffixed(right, clashes, "_y")
            names = [c for f in (*done, right) for c in f.columns if c != key]
            if len(names) != len(set(names)):
                raise ValueError(f"cannot tell the columns {sorted(clashes)} apart by suffix")
        done.append(right)
    return done


def _suffixed(df: DataFrame, names, suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c in names})


def _merge_by_grouping(frames: list[DataFrame], key: str) -> DataFrame:
    tagged = [f.withColumn(f"_in{i}", F.lit(1)) for i, f in enumerate(frames)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    values = [c for f in frames for c in f.columns if c != key]
    counts = [f"_in{i}" for i in range(len(frames))]
    grouped = stacked.groupBy(key).agg(*[F.max(c).alias(c) for c in values], *[F.sum(c).alias(c) for c in counts])
    repeated = F.greatest(*[F.coalesce(c, F.lit(0)) for c in counts], F.lit(0)) > 1
    bad = F.raise_error(F.concat(F.lit("repeated key: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return grouped.filter(F.when(repeated, bad.cast("boolean")).otherwise(F.lit(True))).select(key, *values)
