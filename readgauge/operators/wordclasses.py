"""Word classes learned per language, and content words by them, without a word list.

A hidden Markov model with ``CLASSES`` states is fitted to the sentences of each language by expectation-maximisation (Baum-Welch).
Symbols are the language's ``VOCABULARY`` most frequent words of at least ``LEAST`` occurrences, ties by word; all others are one more
symbol. Each round is one pass over the stored sentences for all languages: tasks run forward-backward on theirs and add up
expected counts, whose size is set by languages, classes and vocabulary. At most about ``SENTENCES`` sentences of a language,
chosen by hash, are trained on; vocabulary and results cover all texts.

A word belongs to the class that it is most often expected in. Content classes: the classes of a language are ordered by the
effective number of their words (exp of the entropy of their emissions), as closed classes have few words that come often.
The first ones that together hold at most ``FUNCTION_SHARE`` of the language's words are function classes, the others and all
words beyond the vocabulary are content. Random starts come from a fixed seed. A null language is a language of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import scratch_path
from .chains import forward_backward, padded
from .vectors import Lexicon

CLASSES = 12
VOCABULARY = 5_000
LEAST = 3
SENTENCES = 20_000
ROUNDS = 15
FUNCTION_SHARE = 0.5
TASKS = 64
TINY = 1e-300


@dataclass(frozen=True)
class Markov:
    """Probabilities of first classes, moves, and symbols (the last one stands for unknown words)."""

    first: np.ndarray
    moves: np.ndarray
    emits: np.ndarray

    @classmethod
    def random(cls, k: int, symbols: int, seed: int) -> Markov:
        rng = np.random.default_rng(seed)
        share = lambda *shape: (lambda x: x / x.sum(axis=-1, keepdims=True))(1 + rng.random(shape))
        return cls(share(k), share(k, k), share(k, symbols))

    def expected(self, words: np.ndarray, begins: np.ndarray) -> tuple[float, Markov]:
        """Log-likelihood of sentences and the expected counts; ``begins``: where each sentence's words begin."""
        logs = [np.log(np.maximum(x, TINY)) for x in (self.first, self.moves, self.emits)]
        first, moves, emits = np.zeros_like(self.first), np.zeros_like(self.moves), np.zeros_like(self.emits)
        scores, total = logs[2].T[words], 0.0
        for at, sizes, x in padded(scores, begins):
            found, p, steps = forward_backward(x, sizes, logs[1], logs[0], np.zeros(len(first)))
            total += found.sum()
            first += p[:, 0].sum(axis=0)
            moves += steps
            inside = at >= 0
            for k in range(len(first)):
                emits[k] += np.bincount(words[at[inside]], p[inside][:, k], emits.shape[1])
        return total, Markov(first, moves, emits)

    def normal(self) -> Markov:
        """Counts as probabilities; a class that nothing came to keeps equal ones."""
        def share(x):
            total = x.sum(axis=-1, keepdims=True)
            return np.where(total > 0, x / np.maximum(total, TINY), 1 / x.shape[-1])
        return Markov(share(self.first), share(self.moves), share(self.emits))


def function_classes(counts: Markov, share: float = FUNCTION_SHARE) -> set[int]:
    """Classes of few words that hold at most ``share`` of all, the narrowest first."""
    mass = counts.emits.sum(axis=1)
    p = counts.emits / np.maximum(mass, TINY)[:, None]
    width = np.exp(-(p * np.log(np.maximum(p, TINY))).sum(axis=1))
    out, held = set(), 0.0
    for k in sorted(range(len(mass)), key=lambda k: (width[k], k)):
        held += mass[k] / max(mass.sum(), TINY)
        if held > share:
            break
        out.add(k)
    return out


@dataclass(frozen=True)
class WordClasses:
    """Per language its words, best first, their classes, and the function classes."""

    words: dict[str | None, list[tuple[str, int]]]
    classes: dict[str | None, np.ndarray]
    function: dict[str | None, set[int]]
    likelihoods: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, text: str, lang: str, classes: int = CLASSES, size: int = VOCABULARY, least: int = LEAST,
            rounds: int = ROUNDS, most: int = SENTENCES, seed: int = 42) -> WordClasses:
        spark = df.sparkSession
        counted = df.select(F.col(lang).alias("lang"), F.explode(tx.lower_words(F.col(text))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
        best = Window.partitionBy("lang").orderBy(F.desc("n"), "w")
        known = counted.filter(F.col("n") >= least).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= size)
        words: dict = {}
        for row in known.select("lang", "w", "n", F.xxhash64("w").alias("h")).orderBy("lang", "place").collect():
            words.setdefault(row["lang"], []).append((row["w"], row["n"], row["h"]))
        langs = list(words)
        lexicons = [Lexicon(np.array([h for *_, h in words[x]], np.int64)) for x in langs]
        rows = _sentences(df, text, lang, langs, lexicons, most)
        models = [Markov.random(classes, len(words[x]) + 1, seed) for x in langs]
        counts, found = models, []
        for _ in range(rounds if langs else 0):
            total, counts = _expected(rows, models)
            found.append(total)
            models = [c.normal() for c in counts]
        return cls({x: [(w, n) for w, n, _ in words[x]] for x in langs}, {x: c.emits.argmax(axis=0)[:-1] for x, c in zip(langs, counts)},
                   {x: function_classes(c) for x, c in zip(langs, counts)}, tuple(found))

    def table(self, spark) -> DataFrame:
        """``lang, w, n, class, content`` of the vocabularies."""
        rows = [(x, w, n, int(k), int(k) not in self.function[x]) for x, own in self.words.items() for (w, n), k in zip(own, self.classes[x])]
        return spark.createDataFrame(rows, "lang string, w string, n long, class int, content boolean")

    def function_words(self, lang) -> list[str]:
        return [w for (w, _), k in zip(self.words[lang], self.classes[lang]) if k in self.function[lang]]

    def content(self, words: Column, lang: Column) -> Column:
        """The content words of an array of lower-case words of the given language; all words of an unknown language."""
        out = words
        for x in self.words:
            listed = self.function_words(x)
            if listed:
                own = lang.isNull() if x is None else lang == F.lit(x)
                out = F.when(own, _without(words, listed)).otherwise(out)
        return out


def _without(words: Column, listed: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*listed))


def _sentences(df: DataFrame, text: str, lang: str, langs: list, lexicons: list[Lexicon], most: int) -> DataFrame:
    """``l, ids``: number of the language and symbols of each chosen sentence, written once."""
    spark = df.sparkSession
    parts = df.select(F.col(lang).alias("lang"), F.explode(tx.lower_sentences(F.col(text))).alias("s"))
    each = {r["lang"]: r["n"] for r in parts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    number, share = F.lit(-1), F.lit(1.0)
    for i, x in enumerate(langs):
        own = F.col("lang").isNull() if x is None else F.col("lang") == F.lit(x)
        number, share = F.when(own, F.lit(i)).otherwise(number), F.when(own, F.lit(min(1.0, most / each[x]))).otherwise(share)
    chosen = F.pmod(F.xxhash64("s"), F.lit(1 << 20)) < share * F.lit(1 << 20)
    rows = parts.filter(chosen).select(number.alias("l"), F.transform(tx.words(F.col("s")), lambda w: F.xxhash64(w)).alias("hashes"))
    given = spark.sparkContext.broadcast(lexicons)

    def numbered(batches):
        for batch in batches:
            langs_of = batch.column("l").to_numpy()
            lists = batch.column("hashes")
            sizes = lists.value_lengths().to_numpy()
            hashes, of = lists.flatten().to_numpy(), np.repeat(langs_of, sizes)
            ids = np.zeros(len(hashes), np.int32)
            for i, lexicon in enumerate(given.value):
                own = of == i
                found = lexicon.find(hashes[own])
                ids[own] = np.where(found < 0, len(lexicon.hashes), found)
            yield pa.RecordBatch.from_arrays([batch.column("l"), pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))], ["l", "ids"])

    path = scratch_path(spark, "sentences")
    rows.filter((F.col("l") >= 0) & (F.size("hashes") > 0)).mapInArrow(numbered, "l int, ids array<int>").write.parquet(path)
    return spark.read.parquet(path).coalesce(TASKS)  # of a bounded sample


def _expected(rows: DataFrame, models: list[Markov]) -> tuple[float, list[Markov]]:
    """Log-likelihood of all sentences and each language's expected counts."""
    given = rows.sparkSession.sparkContext.broadcast(models)

    def count(batches):
        sums = [None] * len(given.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                langs = part.column("l").to_numpy()
                for i in np.unique(langs).tolist():
                    lists = part.column("ids").take(pa.array(np.flatnonzero(langs == i)))
                    begins = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                    total, found = given.value[i].expected(lists.flatten().to_numpy().astype(np.int64), begins)
                    flat = np.concatenate([[total], found.first, found.moves.ravel(), found.emits.ravel()])
                    sums[i] = flat if sums[i] is None else sums[i] + flat
        some = [i for i, x in enumerate(sums) if x is not None]
        yield pa.RecordBatch.from_pydict({"l": pa.array(some, pa.int32()), "sums": pa.array([sums[i].tobytes() for i in some], pa.binary())})

    total = [0.0] * len(models)
    for row in rows.mapInArrow(count, "l int, sums binary").collect():
        total[row["l"]] = total[row["l"]] + np.frombuffer(row["sums"])
    given.unpersist()
    out, likelihood = [], 0.0
    for model, flat in zip(models, total):
        k, v = model.emits.shape
        flat = np.zeros(1 + k + k * k + k * v) if isinstance(flat, float) else flat
        likelihood += flat[0]
        out.append(Markov(flat[1:1 + k], flat[1 + k:1 + k + k * k].reshape(k, k), flat[1 + k + k * k:].reshape(k, v)))
    return likelihood, out
