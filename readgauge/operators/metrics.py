"""Evaluation of predicted classes, class weights and encodings, best results."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)`` for every pair of classes, zeros included.

    Counted first, so all that follows works on one row per pair that occurs.
    """
    counts = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )
    # the set of classes, as one array: the matrix that is asked for has its square as its size
    classes = counts.select(F.explode(F.array("label", "prediction")).alias("c")).agg(
        F.sort_array(F.collect_set("c")).alias("classes")
    )
    empty = classes.select(F.explode("classes").alias("label"), "classes").select(
        "label", F.explode("classes").alias("prediction"), F.lit(0).cast("long").alias("n")
    )
    return counts.unionByName(empty).groupBy("label", "prediction").agg(F.sum("n").alias("n"))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(class, precision, recall, f1, support)``, then 'accuracy', 'macro avg' and 'weighted avg'.

    The accuracy stands in column ``f1`` of its row. One pass counts the pairs of
    classes; a ratio over nothing is 0.
    """
    counts = df.groupBy(F.col(label).cast("string").alias("l"), F.col(prediction).cast("string").alias("p")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)
    roles = counts.select(F.inline(F.array(
        F.struct(F.col("l").alias("class"), hit.alias("tp"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted")),
    )))
    sums = roles.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "actual", "predicted")])

    def share(top, bottom):
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    rows = sums.select(
        "class", share(F.col("tp"), F.col("predicted")).alias("precision"),
        share(F.col("tp"), F.col("actual")).alias("recall"),
        share(2 * F.col("tp"), F.col("predicted") + F.col("actual")).alias("f1"),
        F.col("actual").alias("support"),
    )
    scores = ("precision", "recall", "f1")
    macro = rows.agg(*[F.avg(c).alias(c) for c in scores], F.sum("support").alias("support"))
    weighted = rows.agg(
        *[share(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in scores],
        F.sum("support").alias("support"),
    )
    overall = sums.agg(
        F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
        share(F.sum("tp"), F.sum("actual")).alias("f1"), F.sum("actual").alias("support"),
    )
    named = {"accuracy": overall, "macro avg": macro, "weighted avg": weighted}
    return reduce(lambda done, name: done.unionByName(named[name].withColumn("class", F.lit(name))), named, rows)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, weight)`` with weight n / (k n_c): rows over classes times class rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    # the window runs over one row per class
    every = Window.partitionBy()
    return counts.select(
        label, (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight")
    )


def fit_label_encoder(df: DataFrame, column: str, out: str = "label") -> StringIndexerModel:
    """Classes in sorted order become 0, 1, …; the model keeps their names."""
    indexer = StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="error")
    return indexer.fit(df)


def decode_labels(df: DataFrame, column: str, labels, out: str) -> DataFrame:
    return IndexToString(inputCol=column, outputCol=out, labels=list(labels)).transform(df)


def top_k(df: DataFrame, by: str, k: int, *tiebreak: str, largest: bool = True) -> DataFrame:
    """The ``k`` rows with the largest (or smallest) ``by``, ties in order of ``tiebreak``."""
    first = F.desc(by) if largest else F.asc(by)
    return df.orderBy(first, *tiebreak).limit(k)


def cumulative(df: DataFrame, value: str, order: str, out: str = "cumulative") -> DataFrame:
    """Running sum. For short tables such as one row per component: the order is global."""
    running = Window.partitionBy().orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(running))
