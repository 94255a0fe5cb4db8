"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation maximisation over the counts of vote
patterns (at most 3 ** len(LABELLERS) of them, counted over all documents) estimates how often each labeller votes what on good
and on bad documents; the posterior of a pattern is its weak label. A logistic model over hashed features, trained
with these labels as weights, scores every document. Training reads about TRAIN_ROWS texts at most, chosen by their hash
and taken once each, so neither the corpus nor a text with many copies makes fitting dearer; counting and scoring read all.

Null and empty texts have no words and are rejected. Repeated rows each get a row and equal texts equal scores; with
no document to learn from, nothing is returned. Input columns come back as a struct, so their names can't clash.
"""

from __future__ import annotations

from math import log

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000
FEATURES = 1 << 15
EM_STEPS = 100
LEAST = 0.5
BAD, GOOD, NONE = 1, 0, -1


def measures(text: Column) -> dict[str, Column]:
    """Shares per word: distinct words, words equal to the one before, bars, symbol tails, capitals, sentence ends."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    per_word = lambda pattern: F.try_divide(F.regexp_count(text, F.lit(pattern)), n)
    return {
        "n": n, "distinct": F.try_divide(F.size(F.array_distinct(words)), n),
        "again": per_word(r"(?<!\S)(\S++)\s++\1(?!\S)"), "bars": per_word(r"\|"), "tails": per_word(r"[#$%&*!?^~=+@_]{2,}"),
        "capitals": per_word(r"\p{Lu}{2}"), "ends": per_word(r"[.!?](?!\S)"),
        "width": F.try_divide(F.length(text), n),
    }


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


# Name -> (votes bad, votes good); a null measure votes nothing.
LABELLERS = {
    "repeats": ("again > 0.2", "again < 0.08"),
    "variety": ("distinct < 0.4", "distinct > 0.5"),
    "tables": ("bars > 0.1", "bars = 0"),
    "symbols": ("tails > 0.1", "tails < 0.02"),
    "capitals": ("capitals > 0.3", "capitals < 0.05"),
    "sentences": ("ends > 0.6", "ends > 0.02 and ends < 0.3"),
    "widths": ("width > 15 or width < 2.5", "width > 3.5 and width < 12"),
}


def voted(docs: DataFrame) -> DataFrame:
    """``doc`` (the input row), ``text``, ``m`` (measures) and ``votes``."""
    df = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("m", F.struct(*(c.alias(n) for n, c in measures(F.col("text")).items())))
    names = [f.name for f in df.schema["m"].dataType]

    def condition(expression):
        for n in names:
            expression = " ".join(f"m.{n}" if word == n else word for word in expression.split())
        return F.expr(expression)

    votes = F.array(*(vote(condition(b), condition(g)) for b, g in LABELLERS.values()))
    return df.withColumn("votes", votes)


def estimate(patterns: list[tuple[tuple[int, ...], int]], steps: int = EM_STEPS) -> tuple[dict, list, float]:
    """Posterior of ``bad`` per pattern, the labellers' vote shares given (good, bad), and the share of bad ones.

    Votes are taken as independent given the class. One bad vote starts a pattern as bad; counts are smoothed by one.
    """
    post = {p: 0.9 if BAD in p else 0.05 for p, _ in patterns}
    table, prior = [], 0.5
    for _ in range(steps):
        total = sum(n for _, n in patterns)
        prior = (sum(post[p] * n for p, n in patterns) + 1) / (total + 2)
        table = []
        for j in range(len(LABELLERS)):
            rows = []
            for bad in (False, True):
                counts = dict.fromkeys((NONE, GOOD, BAD), 1.0)
                for p, n in patterns:
                    counts[p[j]] += n * (post[p] if bad else 1 - post[p])
                rows.append({v: c / sum(counts.values()) for v, c in counts.items()})
            table.append(rows)
        new = {}
        for p, _ in patterns:
            odds = log(prior / (1 - prior)) + sum(log(table[j][1][v] / table[j][0][v]) for j, v in enumerate(p))
            new[p] = 1 / (1 + 2.718281828459045 ** -max(-500.0, min(500.0, odds)))
        done = max((abs(new[p] - post[p]) for p in new), default=0) < 1e-9
        post = new
        if done:
            break
    return post, table, prior


def tokens(text: Column, m: Column) -> Column:
    """Distinct lower-case words, and each measure cut into steps."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
    steps = [F.concat(F.lit(f"<{n}>"), F.coalesce(F.least(F.floor(m[n] * k), F.lit(top)).cast("string"), F.lit("-")))
             for n, k, top in (("distinct", 10, 10), ("again", 20, 20), ("bars", 20, 20), ("tails", 20, 20),
                               ("capitals", 20, 20), ("ends", 20, 20), ("width", 1, 20))]
    return F.concat(words, F.array(*steps))


class QualityModel:
    """Labeller statistics and the fitted scorer."""

    def __init__(self, posterior: dict, table: list, prior: float, scorer: LogisticRegressionModel | None, features: int):
        self.posterior, self.table, self.prior, self.scorer, self.features = posterior, table, prior, scorer, features

    @classmethod
    def fit(cls, docs: DataFrame, rows: int = TRAIN_ROWS, features: int = FEATURES) -> QualityModel:
        df = voted(docs)
        counted = df.groupBy("votes").count().collect()
        patterns = sorted((tuple(r["votes"]), r["count"]) for r in counted)
        if not patterns:
            return cls({}, [], 0.5, None, features)
        posterior, table, prior = estimate(patterns)
        share = min(1.0, rows / sum(n for _, n in patterns))
        chosen = voted(docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1_000_000_000)) < int(share * 1_000_000_000)).distinct())
        known = cls(posterior, table, prior, None, features)
        weak = known.vectors(chosen).withColumn("bad", known.label(F.col("votes")))
        weak = weak.select("features", F.explode(F.array(
            F.struct(F.lit(1.0).alias("label"), F.col("bad").alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (1 - F.col("bad")).alias("weight")))).alias("w")).select("features", "w.*")
        weak = weak.where("weight > 0").persist()
        try:
            if not weak.limit(1).count():
                return known
            known.scorer = LogisticRegression(maxIter=40, regParam=0.001, standardization=False, weightCol="weight").fit(weak)
        finally:
            weak.unpersist()
        return known

    def label(self, votes: Column) -> Column:
        """Posterior of ``bad``; a pattern that was not counted is as good as the prior."""
        keys, values = zip(*((",".join(map(str, p)), float(v)) for p, v in self.posterior.items()))
        table = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*map(F.lit, values)))
        return F.coalesce(F.try_element_at(table, F.array_join(F.transform(votes, lambda v: v.cast("string")), ",")),
                          F.lit(float(self.prior)))

    def vectors(self, df: DataFrame) -> DataFrame:
        df = df.withColumn("tokens", tokens(F.col("text"), F.col("m")))
        return HashingTF(numFeatures=self.features, binary=True, inputCol="tokens", outputCol="features").transform(df)

    def score(self, docs: DataFrame, least: float = LEAST) -> DataFrame:
        """``doc`` (the input row), ``n_words, votes, weak_bad, quality, keep`` for every row."""
        df = voted(docs)
        if self.scorer is None:
            return df.select("doc", F.col("m.n").alias("n_words"), "votes", F.lit(self.prior).alias("weak_bad"),
                             (1 - F.lit(self.prior)).alias("quality"), (F.col("m.n") > 0).alias("keep"))
        model = self.scorer.copy()
        model.setFeaturesCol("features").setProbabilityCol("p").setRawPredictionCol("").setPredictionCol("")
        scored = model.transform(self.vectors(df)).withColumn("quality", vector_to_array("p")[0])
        return scored.select(
            "doc", F.col("m.n").alias("n_words"), "votes", self.label(F.col("votes")).alias("weak_bad"), "quality",
            ((F.col("quality") >= least) & (F.col("m.n") > 0)).alias("keep"))
