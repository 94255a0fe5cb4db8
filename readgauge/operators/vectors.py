"""Sentence vectors learned from a corpus, and the similarity of neighbouring sentences by them.

1. Vocabulary: the at most ``VOCABULARY`` most frequent words of at least ``LEAST`` occurrences, ties by word.
2. Co-occurrence: pairs of vocabulary words at most ``WINDOW`` words apart in a sentence, counted in both directions.
3. Association: positive pointwise mutual information, ``max(0, ln(n(a, b) N / (n(a) n(b))))``.
4. Word vectors: the ``WIDTH`` leading factors of that symmetric matrix by randomised subspace iteration. Each pass multiplies
   the matrix, a table spread over the tasks, with the present basis; the basis, ``VOCABULARY`` by ``WIDTH`` at most whatever
   the corpus, is sent to the tasks and orthonormalised between passes.
5. Sentence vectors: word vectors weighted by ``SMOOTH / (SMOOTH + share of the word)``, averaged, less their projection on the
   first principal direction of all sentences.

A sentence without vocabulary words has the vector 0, and a cosine with it is 0. Texts with fewer than two sentences have the
similarity 1. Random numbers come from a fixed seed, signs are fixed, so fits of the same corpus agree but for rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import scratch_path
from .language import count_words

VOCABULARY = 50_000
LEAST = 5
WINDOW = 4
WIDTH = 48
PASSES = 3
SMOOTH = 1e-3
PAIRS_HELD = 4_000_000
WORDS_AT_ONCE = 50_000


def vocabulary(df: DataFrame, text: str, size: int = VOCABULARY, least: int = LEAST) -> DataFrame:
    """``(w, n)`` of the most frequent words."""
    return count_words(df, text).filter(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(size)


def _hashed(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The kept columns and ``_s``: hashes of the words of each sentence."""
    hashes = F.transform(tx.lower_sentences(F.col(text)), lambda s: F.transform(tx.words(s), lambda w: F.xxhash64(w)))
    return df.select(*keep, hashes.alias("_s"))


class Lexicon:
    """Hashes of the vocabulary, sorted, with each word's number."""

    def __init__(self, hashes: np.ndarray):
        self.number = np.argsort(hashes)
        self.hashes = hashes[self.number]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.number[at], -1)


def _flat(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all sentences, where each sentence begins among them, and where each text begins among the sentences."""
    sentences = column.flatten()
    texts = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
    words = np.concatenate([[0], np.cumsum(sentences.value_lengths().fill_null(0).to_numpy())])
    return sentences.flatten().to_numpy(), words, texts


def cooccurrences(df: DataFrame, text: str, lexicon: Lexicon, window: int = WINDOW, held_most: int = PAIRS_HELD) -> DataFrame:
    """``(a, b, n)`` with a <= b: how often two vocabulary words stand within the window."""
    given = df.sparkSession.sparkContext.broadcast(lexicon)

    def count(batches):
        held, size = [], 0
        n_words = len(given.value.hashes)

        def summed():
            code, n = (np.concatenate(x) for x in zip(*held))
            pairs, at = np.unique(code, return_inverse=True)
            return [(pairs, np.bincount(at, n, len(pairs)).astype(np.int64))]

        def given_out():
            for code, n in held:
                for low in range(0, len(code), 1 << 16):
                    part = code[low:low + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(part // n_words, pa.int32()), pa.array(part % n_words, pa.int32()),
                        pa.array(n[low:low + (1 << 16)])], ["a", "b", "n"])

        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                hashes, begins, _ = _flat(batch.column("_s").slice(low, 500))
                ids = given.value.find(hashes)
                sentence = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
                for k in range(1, window + 1):
                    a, b = ids[:-k], ids[k:]
                    near = (sentence[:-k] == sentence[k:]) & (a >= 0) & (b >= 0)
                    code, n = np.unique(np.minimum(a, b)[near] * n_words + np.maximum(a, b)[near], return_counts=True)
                    held.append((code, n))
                    size += len(code)
                if size > held_most:
                    held = summed()
                    size = len(held[0][0])
                    if size > held_most // 2:
                        yield from given_out()
                        held, size = [], 0
        if held:
            held = summed()
            yield from given_out()

    counted = _hashed(df, text).mapInArrow(count, "a int, b int, n bigint")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def association(pairs: DataFrame) -> DataFrame:
    """``(a, b, n, ppmi)`` for both directions of every pair; ``pairs`` as from ``cooccurrences``. 0 or less is left out.

    The sums by word, as many as the vocabulary has words at most, are sent to the tasks; the pairs are counted and written
    once and don't move again.
    """
    path = scratch_path(pairs.sparkSession, "pairs")
    pairs.write.parquet(path)
    pairs = pairs.sparkSession.read.schema(pairs.schema).parquet(path)
    same = F.col("a") == F.col("b")
    both = pairs.select(F.inline(F.when(same, F.array(F.struct("a", "b", (F.col("n") * 2).alias("n")))).otherwise(F.array(
        F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n"))))))
    margins = both.groupBy("a").agg(F.sum("n").alias("n_a"))
    total = margins.agg(F.coalesce(F.sum("n_a"), F.lit(0)).alias("total")).first()["total"]
    joined = both.join(F.broadcast(margins), "a").join(F.broadcast(margins.withColumnsRenamed({"a": "b", "n_a": "n_b"})), "b")
    value = F.log(F.col("n").cast("double") * float(total) / (F.col("n_a").cast("double") * F.col("n_b").cast("double")))
    return joined.select("a", "b", "n", value.alias("ppmi")).filter("ppmi > 0")


def _product(matrix: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The matrix, rows of ``a, b, ppmi``, times the basis."""
    given = matrix.sparkSession.sparkContext.broadcast(basis)
    size, width = basis.shape

    def multiply(batches):
        q, total, seen = given.value, np.zeros((size, width)), np.zeros(size, bool)
        for batch in batches:
            for low in range(0, batch.num_rows, WORDS_AT_ONCE):
                a, b, value = (c.to_numpy(zero_copy_only=False) for c in batch.slice(low, WORDS_AT_ONCE).columns)
                order = np.argsort(a, kind="stable")
                rows, first = np.unique(a[order], return_index=True)
                if len(rows):
                    total[rows] += np.add.reduceat(q[b[order]] * value[order][:, None], first)
                    seen[rows] = True
        rows = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(total[rows].ravel()), width).cast(pa.list_(pa.float64()))],
            ["a", "v"])

    out = np.zeros((size, width))
    for batch in matrix.select("a", "b", "ppmi").mapInArrow(multiply, "a int, v array<double>").toArrow().to_batches():
        np.add.at(out, batch.column("a").to_numpy(), batch.column("v").flatten().to_numpy().reshape(-1, width))
    given.unpersist()
    return out


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of the greatest magnitude is positive."""
    if not vectors.size:
        return vectors
    top = np.abs(np.round(vectors, 9)).argmax(axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def factors(matrix: DataFrame, size: int, width: int = WIDTH, passes: int = PASSES, seed: int = 42) -> np.ndarray:
    """``size`` by at most ``width``: leading eigenvectors times the root of their eigenvalues' magnitude."""
    width = min(width, size)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0] if size else np.zeros((0, 0))
    for _ in range(passes if size else 0):
        basis = np.linalg.qr(_product(matrix, basis))[0]
    if not size:
        return basis
    small = basis.T @ _product(matrix, basis)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")
    return signed(basis @ turned[:, order]) * np.sqrt(np.abs(values[order]))


@dataclass(frozen=True)
class SentenceModel:
    """Word vectors, already weighted, and the direction taken out of every sentence."""

    lexicon: Lexicon
    vectors: np.ndarray
    common: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, text: str, size: int = VOCABULARY, least: int = LEAST, window: int = WINDOW, width: int = WIDTH,
            passes: int = PASSES, seed: int = 42) -> SentenceModel:
        spark = df.sparkSession
        known = vocabulary(df, text, size, least).select(F.xxhash64("w").alias("h"), "n").toPandas()
        lexicon = Lexicon(known["h"].to_numpy(np.int64))
        path = scratch_path(spark, "ppmi")
        association(cooccurrences(df, text, lexicon, window)).write.parquet(path)
        found = factors(spark.read.parquet(path), len(known), width, passes, seed)
        n = known["n"].to_numpy(float)
        share = n / max(df.agg(F.coalesce(F.sum(tx.word_count(F.lower(F.col(text)))), F.lit(0))).first()[0], 1)
        weighted = found * (SMOOTH / (SMOOTH + share))[:, None] if len(n) else found
        plain = cls(lexicon, weighted, np.zeros(weighted.shape[1]))
        gram = plain._gram(df, text)
        common = signed(np.linalg.eigh(gram)[1][:, -1:])[:, 0] if gram.any() else plain.common
        return cls(lexicon, weighted, common)

    def of_sentences(self, hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """A vector for each sentence, given the hashes of all words and where each sentence begins."""
        out = np.zeros((len(begins) - 1, self.vectors.shape[1]))
        low = 0
        while low < len(out):  # some sentences at a time
            high = max(low + 1, int(np.searchsorted(begins, begins[low] + WORDS_AT_ONCE, "right")) - 1)
            ids = self.lexicon.find(hashes[begins[low]:begins[high]])
            of = np.repeat(np.arange(low, high), np.diff(begins[low:high + 1]))
            of, ids = of[ids >= 0], ids[ids >= 0]
            if len(ids):
                rows, first = np.unique(of, return_index=True)
                out[rows] = np.add.reduceat(self.vectors[ids], first) / np.diff(np.append(first, len(of)))[:, None]
            low = high
        return out - (out @ self.common)[:, None] * self.common

    def _gram(self, df: DataFrame, text: str) -> np.ndarray:
        given, width = df.sparkSession.sparkContext.broadcast(self), self.vectors.shape[1]

        def add(batches):
            total = np.zeros((width, width))
            for batch in batches:
                for low in range(0, batch.num_rows, 500):
                    hashes, begins, _ = _flat(batch.column("_s").slice(low, 500))
                    v = given.value.of_sentences(hashes, begins)
                    total += v.T @ v
            yield pa.RecordBatch.from_pydict({"g": [total.ravel().tolist()]})

        rows = _hashed(df, text).mapInArrow(add, "g array<double>").select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("v"))
        out = np.zeros(width * width)
        for row in rows.collect():
            out[row["pos"]] = row["v"]
        return out.reshape(width, width)

    def neighbour_similarity(self, df: DataFrame, text: str, *keep: str, out: str = "similarity") -> DataFrame:
        """The kept columns and the mean cosine of neighbouring sentences; in the row, nothing is shuffled."""
        given = df.sparkSession.sparkContext.broadcast(self)
        rows = _hashed(df, text, *keep)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + f", {out} double"

        def measure(batches):
            for batch in batches:
                for low in range(0, batch.num_rows, 500):
                    part = batch.slice(low, 500)
                    hashes, begins, texts = _flat(part.column("_s"))
                    v = given.value.of_sentences(hashes, begins)
                    norm = np.sqrt((v * v).sum(axis=1))
                    scale = norm[:-1] * norm[1:]
                    cosine = np.divide((v[:-1] * v[1:]).sum(axis=1), scale, out=np.zeros(max(len(v) - 1, 0)), where=scale > 1e-18)
                    upto = np.concatenate([[0], np.cumsum(cosine)])
                    n = np.diff(texts) - 1  # pairs of each text; those across texts are not among them
                    last = np.minimum(np.maximum(texts[1:] - 1, texts[:-1]), len(upto) - 1)
                    first = np.minimum(texts[:-1], len(upto) - 1)
                    mean = np.where(n > 0, (upto[last] - upto[first]) / np.maximum(n, 1), 1.0)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(mean)], [*part.schema.names[:-1], out])

        return rows.mapInArrow(measure, schema)


def word_pairs(df: DataFrame, text: str, size: int = VOCABULARY, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """``(w, near, n, ppmi)``: associated vocabulary words by name, both directions."""
    spark: SparkSession = df.sparkSession
    words = vocabulary(df, text, size, least).toPandas()
    hashes = spark.createDataFrame(words[["w"]], "w string").select("w", F.xxhash64("w").alias("h")).toPandas().set_index("w")["h"]
    lexicon = Lexicon(hashes.loc[words["w"]].to_numpy(np.int64)) if len(words) else Lexicon(np.zeros(0, np.int64))
    names = spark.createDataFrame(list(enumerate(words["w"].tolist())), "a int, w string")  # at most the vocabulary's size
    found = association(cooccurrences(df, text, lexicon, window))
    found = found.join(F.broadcast(names), "a").join(F.broadcast(names.withColumnsRenamed({"a": "b", "w": "near"})), "b")
    return found.select("w", "near", "n", "ppmi")
