"""Imputation, standardisation, principal components, correlation and splits."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.ml.feature import PCA, Imputer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bounded import settled
from .metrics import cumulative


def impute_mean(df: DataFrame, columns) -> DataFrame:
    """Nulls of each column become its mean."""
    columns = list(columns)
    doubles = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return Imputer(strategy="mean", inputCols=columns, outputCols=columns).fit(doubles).transform(doubles)


@dataclass(frozen=True)
class Standardizer:
    """Mean and population deviation per column; a zero deviation counts as 1."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, columns) -> Standardizer:
        columns = tuple(columns)
        row = df.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
        return cls(columns, tuple(row[0::2]), tuple(s or 1.0 for s in row[1::2]))

    def column(self, name: str) -> Column:
        i = self.columns.index(name)
        return (F.col(name) - F.lit(self.means[i])) / F.lit(self.scales[i])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.column(c) for c in self.columns})


@dataclass(frozen=True)
class PrincipalComponents:
    """Components of standardised, mean-filled columns.

    Of each component the loading with the largest magnitude is positive.
    """

    columns: tuple[str, ...]
    loadings: tuple[tuple[float, ...], ...]  # one tuple per component
    ratios: tuple[float, ...]
    standardizer: Standardizer
    fill: dict

    @classmethod
    def fit(cls, df: DataFrame, columns, k: int | None = None) -> PrincipalComponents:
        """Default ``k``: the number of columns, or one less than the rows if that is smaller."""
        columns = tuple(columns)
        doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).persist()
        try:
            row = doubles.agg(
                F.count("*").alias("n"), *[f(c) for c in columns for f in (F.count, F.avg, F.stddev_pop)]
            ).first()
            known, means, deviations = row[1::3], row[2::3], row[3::3]
            fill = {c: m or 0.0 for c, m in zip(columns, means)}
            # filling with the mean keeps the mean and shrinks the variance by the share of known values
            scales = [(s or 0.0) * math.sqrt(k / max(row["n"], 1)) or 1.0 for s, k in zip(deviations, known)]
            scaler = Standardizer(columns, tuple(fill.values()), tuple(scales))
            k = min(len(columns), row["n"] - 1) if k is None else k
            scaled = scaler.transform(doubles.fillna(fill))
            vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(scaled)
            model = PCA(k=k, inputCol="v", outputCol="s").fit(vectors.select("v"))
        finally:
            doubles.unpersist()
        loadings = []
        for component in model.pc.toArray().T:
            sign = -1.0 if component[abs(component).argmax()] < 0 else 1.0
            loadings.append(tuple(float(x) for x in sign * component))
        return cls(columns, tuple(loadings), tuple(float(x) for x in model.explainedVariance.toArray()), scaler, fill)

    def scores(self, df: DataFrame, *keep: str) -> DataFrame:
        """The kept columns and ``PC1``… as plain column arithmetic."""
        doubles = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in self.columns])
        scaled = self.standardizer.transform(doubles.fillna(self.fill))
        return scaled.select(*keep, *[
            reduce(Column.__add__, [F.col(c) * F.lit(w) for c, w in zip(self.columns, weights)]).alias(f"PC{i}")
            for i, weights in enumerate(self.loadings, start=1)
        ])

    def loadings_table(self, spark) -> DataFrame:
        """``(feature, PC1…)``: a row per column."""
        rows = [(c, *[w[j] for w in self.loadings]) for j, c in enumerate(self.columns)]
        names = [f"PC{i} double" for i in range(1, len(self.loadings) + 1)]
        return spark.createDataFrame(rows, ", ".join(["feature string", *names]))

    def variance_table(self, spark) -> DataFrame:
        """``(component, ratio, cumulative)``: a row per component."""
        rows = [(i, f"PC{i}", r) for i, r in enumerate(self.ratios, start=1)]
        table = spark.createDataFrame(rows, "k int, component string, ratio double")
        return cumulative(table, "ratio", "k").select("component", "ratio", "cumulative")


def correlation(df: DataFrame, columns) -> DataFrame:
    """``(a, b, corr)`` for each pair of columns, a before b; one pass, two values needed per row."""
    columns = [c for c in columns]
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)
    ])))


def hash_number(key: Column, seed: int = 42) -> Column:
    """The first 32 bits of ``md5('seed|key')`` as a number: even, repeatable, portable."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def in_test(key: Column, fraction: float, seed: int = 42) -> Column:
    """Whether a row belongs to the test part. Decided row by row, without a shuffle."""
    return hash_number(key, seed) < F.lit(int(fraction * 2**32))


def stratified_test_flag(df: DataFrame, key: str, label: str, fraction: float, seed: int = 42,
                         bucket_bits: int = 16) -> DataFrame:
    """Add ``is_test``: of each class exactly ``round(fraction * n)`` rows, those of lowest hash.

    Ranking a class would put it into one task. Instead rows are counted per class
    and leading bits of the hash; the running sum of these counts shows the one
    bucket of each class through which the border runs. Whole buckets are decided
    by comparison, and only the border bucket, a ``2**-bucket_bits`` part of the
    class, is ranked.
    """
    hashed = df.withColumn("_h", hash_number(F.col(key), seed)).withColumn(
        "_bucket", F.shiftright("_h", 32 - bucket_bits)
    )
    counts = hashed.groupBy(label, "_bucket").agg(F.count("*").alias("n"))
    running = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.round(F.sum("n").over(Window.partitionBy(label)) * F.lit(fraction)).cast("long")
    borders = counts.select(
        label, "_bucket", "n", F.sum("n").over(running).alias("upto"), wanted.alias("wanted")
    ).filter(F.col("upto") > F.col("wanted")).groupBy(label).agg(
        F.min("_bucket").alias("_border"),
        F.min_by(F.col("wanted") - (F.col("upto") - F.col("n")), "_bucket").alias("_take"),
    )
    # a class whose rows all are wanted has no border
    placed = hashed.join(settled(borders), label, "left")
    border = F.coalesce(F.col("_bucket") == F.col("_border"), F.lit(False))
    ranked = Window.partitionBy(label, "_bucket").orderBy("_h", key)
    decided = placed.filter(~border).withColumn(
        "is_test", F.coalesce(F.col("_bucket") < F.col("_border"), F.lit(True))
    )
    at_border = placed.filter(border).withColumn("is_test", F.row_number().over(ranked) <= F.col("_take"))
    return decided.unionByName(at_border).select(*df.columns, "is_test")
