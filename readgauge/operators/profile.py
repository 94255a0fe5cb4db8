"""Quality statistics and distributions of feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import duplicate_keys
from .bounded import settled

__all__ = ["class_distribution", "density_curves", "describe", "duplicate_keys", "feature_density", "feature_histogram",
           "feature_kde", "histograms", "null_profile"]

QUARTILES = (0.25, 0.5, 0.75)


def _melt(df: DataFrame, columns, by=()) -> DataFrame:
    """``(by…, feature, value)`` of the non-null values, as doubles."""
    doubles = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(by), list(columns), "feature", "value").filter("value IS NOT NULL")


def null_profile(df: DataFrame, columns=None) -> DataFrame:
    """``(column, n_null)`` of the columns that hold nulls, counted in one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.isnull(c)).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "n_null").filter("n_null > 0")


def class_distribution(df: DataFrame, type_col: str = "type") -> DataFrame:
    return df.groupBy(type_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), type_col)


def describe(df: DataFrame, columns, accuracy: int = 100_000) -> DataFrame:
    """Count, mean, sample deviation, minimum, interpolated quartiles, maximum per column.

    Quartiles are exact without sorting or gathering a column. A quantile sketch
    first brackets each quartile to ``4 / accuracy`` of the rows; a second pass
    counts the rows below the bracket and the distinct values inside it, and
    only those are ranked.
    """
    columns = list(columns)
    slack = 2.0 / accuracy
    probes = [p for q in QUARTILES for p in (max(q - slack, 0.0), min(q + slack, 1.0))]
    values = _melt(df, columns)
    basic = values.groupBy("feature").agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.percentile_approx("value", probes, accuracy).alias("probes"),
    )
    # one row per column of the table: bounded by the schema
    brackets = basic.select(
        "feature", "count",
        F.inline(F.array(*[
            F.struct(F.lit(q).alias("q"), F.col("probes")[2 * i].alias("lo"), F.col("probes")[2 * i + 1].alias("hi"))
            for i, q in enumerate(QUARTILES)
        ])),
    )
    ranked = _bracket_quantiles(values, brackets)
    quartiles = ranked.groupBy("feature").agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(f"q{int(q * 100)}") for q in QUARTILES]
    )
    return basic.join(quartiles, "feature", "left").select(
        "feature", "count", "mean", "std", "min", *[f"q{int(q * 100)}" for q in QUARTILES], "max"
    )


def _bracket_quantiles(values: DataFrame, brackets: DataFrame) -> DataFrame:
    """``(feature, q, value)`` by ranking only what falls into each bracket.

    Everything below a bracket folds into one row that keeps its count and its
    largest value, everything above into one with its smallest value, so the
    neighbours of the bracket are at hand when a rank falls on its edge.
    """
    placed = values.join(F.broadcast(brackets), "feature").select(
        "feature", "q", "count", "value",
        F.when(F.col("value") < F.col("lo"), -1).when(F.col("value") > F.col("hi"), 1).otherwise(0).alias("zone"),
    )
    folded = placed.groupBy(
        "feature", "q", "zone", F.when(F.col("zone") == 0, F.col("value")).alias("inner_value")
    ).agg(
        F.count("*").alias("n"), F.first("count").alias("count"),
        F.min("value").alias("low_value"), F.max("value").alias("high_value"),
    ).withColumn("value", F.when(F.col("zone") < 0, F.col("high_value")).otherwise(F.col("low_value")))
    upto = F.sum("n").over(
        Window.partitionBy("feature", "q").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    )
    place = F.col("q") * (F.col("count") - 1)
    cumulated = folded.withColumn("upto", upto).withColumn("place", place)
    lower, upper = F.floor("place"), F.ceil("place")
    ends = cumulated.groupBy("feature", "q").agg(
        F.min(F.when(F.col("upto") > lower, F.col("value"))).alias("a"),
        F.min(F.when(F.col("upto") > upper, F.col("value"))).alias("b"),
        F.first(F.col("place") - lower).alias("part"),
    )
    return ends.select("feature", "q", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("value"))


def _span(values: DataFrame) -> Column:
    """The observed ``low`` and ``high`` as a scalar subquery; a single value gets half a unit on either side."""
    pad = F.when(F.min("value") == F.max("value"), F.lit(0.5)).otherwise(F.lit(0.0))
    return values.agg(F.struct((F.min("value") - pad).alias("low"), (F.max("value") + pad).alias("high")).alias("r")).scalar()


def _values(df: DataFrame, feature: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.col(feature).cast("double").alias("value")).filter("value IS NOT NULL")


def feature_histogram(df: DataFrame, feature: str, group: str, bins: int = 20) -> DataFrame:
    """``(group, bin, n)`` over equal bins of the range observed in all groups together.

    The top edge belongs to the last bin. Bins count from 0; a group has a row for each, empty ones count 0.
    """
    values = _values(df, feature, group)
    span = _span(values)
    step = (span["high"] - span["low"]) / F.lit(float(bins))
    at = F.least(F.floor((F.col("value") - span["low"]) / step), F.lit(bins - 1).cast("long"))
    counts = values.groupBy(group, at.alias("bin")).agg(F.count("*").alias("n"))
    # at most ``bins`` entries per group
    filled = counts.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found"))
    every = filled.select(group, "found", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return every.select(group, "bin", F.coalesce(F.try_element_at("found", F.col("bin")), F.lit(0)).cast("long").alias("n"))


def feature_density(df: DataFrame, feature: str, group: str, bins: int = 20) -> DataFrame:
    """``(group, bin, density)`` over common bins; each group integrates to 1."""
    counts = feature_histogram(df, feature, group, bins)
    span = _span(_values(df, feature))
    # the window runs over at most ``bins`` rows per group
    area = F.sum("n").over(Window.partitionBy(group)) * (span["high"] - span["low"]) / bins
    return counts.select(group, "bin", (F.col("n").cast("double") / area).alias("density"))


def feature_kde(df: DataFrame, feature: str, group: str, points: int = 50) -> DataFrame:
    """``(group, point, x, density)``: a Gaussian kernel estimate per group.

    Bandwidth by Scott's rule, n^(-1/5) times the sample deviation; the grid has
    ``points`` equal steps over the group's own range; a group of equal values has
    no curve. Equal values are counted
    first, each distinct value then adds to every grid point, and these partial
    sums are combined before they are shuffled.
    """
    values = _values(df, feature, group)
    counted = values.groupBy(group, "value").agg(F.count("*").alias("n"))
    shape = values.groupBy(group).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("total"),
        (F.pow(F.count("*").cast("double"), F.lit(-0.2)) * F.stddev_samp("value")).alias("h"),
    ).filter("h > 0")
    spread = counted.join(settled(shape), group)
    step = (F.col("high") - F.col("low")) / (points - 1)
    grid = spread.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    x = F.col("low") + F.col("point") * step
    u = (F.col("value") - x) / F.col("h")
    weight = F.col("n") * F.exp(-u * u / 2) / (F.col("h") * F.sqrt(2 * F.pi()) * F.col("total"))
    return grid.groupBy(group, "point").agg(F.first(x).alias("x"), F.sum(weight).alias("density"))


def shapes(df: DataFrame, features, group: str) -> DataFrame:
    """``(group, feature, low, high, total, h)`` in one pass: range, count and Scott's bandwidth; features without values are left out."""
    features = list(features)
    aggregates = [f(F.col(c).cast("double")).alias(f"{c}{i}") for c in features for i, f in enumerate((F.min, F.max, F.count, F.stddev_samp))]
    wide = df.groupBy(group).agg(*aggregates)
    rows = wide.select(group, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}0").alias("low"), F.col(f"{c}1").alias("high"), F.col(f"{c}2").alias("total"),
                 (F.pow(F.col(f"{c}2").cast("double"), F.lit(-0.2)) * F.col(f"{c}3")).alias("h"))
        for c in features])))
    return rows.filter("total > 0")


def density_curves(df: DataFrame, features, group: str, points: int = 50, cells: int = 1024) -> DataFrame:
    """``(group, feature, point, x, density)``: Gaussian kernel estimates of all features and groups.

    Each value is shared out between the two nearest of ``cells + 1`` places over its curve's range, in proportion to its nearness
    (linear binning). Tasks add these up, so what is shuffled does not grow with the rows, and only places meet grid points. With
    steps of d and a bandwidth of h this differs from the exact sum by at most ``d^2 / (8 h^3 sqrt(2 pi))``.
    Grid and bandwidth are those of ``feature_kde``; equal values have no curve.
    """
    shape = settled(shapes(df, features, group).filter("h > 0"))
    step = (F.col("high") - F.col("low")) / cells
    place = (F.col("value") - F.col("low")) / step
    cell = F.least(F.floor(place), F.lit(cells - 1).cast("long"))
    placed = _melt(df, features, [group]).join(shape, [group, "feature"]).select(group, "feature", cell.alias("cell"), (place - cell).alias("part"))
    counted = placed.groupBy(group, "feature", "cell").agg(F.count("*").alias("n"), F.sum("part").alias("part"))
    both = F.inline(F.array(F.struct("cell", (F.col("n") - F.col("part")).alias("weight")), F.struct((F.col("cell") + 1).alias("cell"), F.col("part").alias("weight"))))
    weights = counted.select(group, "feature", both).groupBy(group, "feature", "cell").agg(F.sum("weight").alias("weight"))
    spread = weights.join(shape, [group, "feature"]).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("low") + F.col("point") * ((F.col("high") - F.col("low")) / (points - 1))
    u = (F.col("low") + F.col("cell") * step - x) / F.col("h")
    share = F.col("weight") * F.exp(-u * u / 2) / (F.col("h") * F.sqrt(2 * F.pi()) * F.col("total"))
    return spread.groupBy(group, "feature", "point").agg(F.first(x).alias("x"), F.sum(share).alias("density"))


def histograms(df: DataFrame, features, group: str, bins: int = 20) -> DataFrame:
    """``(group, feature, bin, n, density)`` of all features over ``bins`` equal bins of each feature's range in all groups.

    One pass for the ranges and one for the counts. Every group has every bin of the features that have values; the densities of a
    group with values integrate to 1, those of others are 0.
    """
    shape = settled(shapes(df, features, group))
    pad = F.when(F.min("low") == F.max("high"), F.lit(0.5)).otherwise(F.lit(0.0))
    span = settled(shape.groupBy("feature").agg((F.min("low") - pad).alias("low"), (F.max("high") + pad).alias("high")))
    step = (F.col("high") - F.col("low")) / F.lit(float(bins))
    at = F.least(F.floor((F.col("value") - F.col("low")) / step), F.lit(bins - 1).cast("long"))
    counts = _melt(df, features, [group]).join(span, "feature").groupBy(group, "feature", at.alias("bin")).agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(c) for c in features])
    every = shape.select(group).distinct().select(group, F.explode(names).alias("feature")).join(span, "feature")
    every = every.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    every = every.join(shape.select(group, "feature", "total"), [group, "feature"], "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    area = F.col("total") * (F.col("high") - F.col("low")) / bins
    return every.join(counts, [group, "feature", "bin"], "left").select(
        group, "feature", "bin", n.alias("n"), F.coalesce(n / area, F.lit(0.0)).alias("density"))
