"""Rhetorical roles of sentences: shares, corpus means and a trainable classifier."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import ratio
from .metrics import class_weights


def role_ratios(sentences: DataFrame, key: str, label: str, labels, documents: DataFrame | None = None) -> DataFrame:
    """Share of sentences per label, ``{label}_ratio``; 0.0 throughout for a text without sentences.

    ``documents`` names the keys to report, else those that have sentences.
    """
    counted = sentences.groupBy(key).agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(label) == x).alias(f"_{x}") for x in labels]
    )
    if documents is not None:
        counted = documents.select(key).join(counted, key, "left")
    n = F.coalesce("_n", F.lit(0))
    return counted.select(key, *[ratio(F.coalesce(f"_{x}", F.lit(0)), n).alias(f"{x}_ratio") for x in labels])


def corpus_role_ratio(sentences: DataFrame, label: str, wanted: str) -> DataFrame:
    """Share of one label in all sentences; 0 for no sentence."""
    return sentences.agg(ratio(F.count_if(F.col(label) == wanted), F.count("*")).alias("ratio"))


def mean_role_ratio(wide: DataFrame, labels, sections=("abstract", "summary")) -> DataFrame:
    """``(label, mean_ratio)``: the mean of the two section means, not the pooled mean."""
    means = mean_role_ratio_by_section(wide, labels, sections)
    return means.groupBy("label").agg(F.avg("mean_ratio").alias("mean_ratio"))


def mean_role_ratio_by_section(wide: DataFrame, labels, sections=("abstract", "summary")) -> DataFrame:
    """``(section, label, mean_ratio)`` in one pass over the wide table."""
    cells = [(s, x, f"{s}_{x}_ratio") for s in sections for x in labels]
    means = wide.agg(*[F.avg(c).alias(c) for _, _, c in cells])
    return means.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(x).alias("label"), F.col(c).alias("mean_ratio")) for s, x, c in cells
    ])))


def fit_role_classifier(sentences: DataFrame, text: str = "sentence", label: str = "label",
                        buckets: int = 1 << 16, max_iter: int = 50, reg: float = 1e-3) -> PipelineModel:
    """Hashed TF-IDF words into a class-weighted logistic regression.

    The fitted pipeline keeps the label names and writes the predicted name to ``role``.
    """
    names = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(sentences)
    weights = class_weights(sentences, label).collect()  # one row per class
    weight = F.lit(1.0)
    for row in weights:
        weight = F.when(F.col(label) == row[label], F.lit(float(row["weight"]))).otherwise(weight)
    featurizer = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=buckets),
        IDF(inputCol="_tf", outputCol="_features"),
    ]).fit(sentences)
    training = names.transform(featurizer.transform(sentences)).withColumn("_weight", weight)
    classifier = LogisticRegression(
        featuresCol="_features", labelCol="_y", weightCol="_weight", predictionCol="_role_id",
        probabilityCol="_probability", rawPredictionCol="_raw", maxIter=max_iter, regParam=reg,
    ).fit(training.select("_features", "_y", "_weight"))
    back = IndexToString(inputCol="_role_id", outputCol="role", labels=names.labels)
    return PipelineModel(stages=[*featurizer.stages, classifier, back])


def predict_roles(model: PipelineModel, sentences: DataFrame) -> DataFrame:
    """The given columns and the predicted ``role``."""
    return model.transform(sentences).select(*sentences.columns, "role")
