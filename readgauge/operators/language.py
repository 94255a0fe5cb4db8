"""Word and word-pair statistics of a corpus: surprisal and perplexity of texts.

``fit`` counts a training corpus once and writes the counts; ``score`` looks
them up for any texts. Two measures come out:

* ``cwe``: mean of -ln(c(w) / N) over the content words of a text that the
  training corpus knows; null without any.
* ``ppl``: exp of the mean of -ln((c(v, w) + 1) / (c(v) + V)) over the
  neighbouring words v, w of a text, where c(v) counts v with a word after it
  and V the distinct words; null below two words. Never below 1.

Scoring looks each distinct pair up once, gives it its value, and joins the values to the occurrences, all by 64-bit hashes of
words or of pairs of them; an occurrence moves as its text's keys and one hash. These are shuffle joins, which adaptive execution
splits where one is frequent. For the texts of the training corpus the words, if there are at most ``BROADCAST_WORDS``, are sent to the tasks instead, so that occurrences of
single words do not move.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.measures import content_words, is_content_word
from ..session import scratch_path


BROADCAST_WORDS = 500_000


def _words(df: DataFrame, text: str, *keep: str, content_only: bool = False) -> DataFrame:
    """The kept columns and one row per lower-case word ``w``; a text without any has one null."""
    found = tx.lower_words(F.col(text))
    listed = df.select(*keep, (content_words(found) if content_only else found).alias("_ws"))
    return listed.select(*keep, F.explode_outer("_ws").alias("w"))


def _followed_words(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Like ``_words`` with the word after it as ``nxt``, null for the last one."""
    tail = F.slice("_ws", F.lit(2), F.greatest(F.size("_ws"), F.lit(1)))
    listed = df.select(*keep, tx.lower_words(F.col(text)).alias("_ws"))
    return listed.select(*keep, F.inline_outer(F.arrays_zip(F.col("_ws").alias("w"), tail.alias("nxt"))))


def count_words(df: DataFrame, text: str) -> DataFrame:
    """``(w, n)`` over all lower-case words."""
    return _words(df, text).filter("w IS NOT NULL").groupBy("w").agg(F.count("*").alias("n"))


def count_followed(df: DataFrame, text: str) -> DataFrame:
    """``(w, nxt, n)``: neighbouring words, and with a null ``nxt`` the last words."""
    followed = _followed_words(df, text).filter("w IS NOT NULL")
    return followed.groupBy("w", "nxt").agg(F.count("*").alias("n"))


def _pair_hashes(df: DataFrame, text: str, *keep: str, parts: bool = False) -> DataFrame:
    """The kept columns and one row per pair of neighbouring words, as hash ``h``; with ``parts`` its words' ``v`` too."""
    listed = df.select(*keep, F.transform(tx.lower_words(F.col(text)), lambda w: F.xxhash64(w)).alias("_ws"))
    n = F.greatest(F.size("_ws") - 1, F.lit(0))
    first, second = F.slice("_ws", F.lit(1), n), F.slice("_ws", F.lit(2), n)
    if not parts:
        return listed.filter(n > 0).select(*keep, F.explode(F.zip_with(first, second, _pair_hash)).alias("h"))
    pairs = F.inline(F.zip_with(first, second, lambda v, w: F.struct(_pair_hash(v, w).alias("h"), v.alias("v"))))
    return listed.filter(n > 0).select(*keep, pairs)


def _pair_hash(v: Column, w: Column) -> Column:
    """One hash for the hashes of two words."""
    return F.xxhash64(v, w)


def _content_hashes(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The kept columns and one row per content word, as hash ``w``."""
    found = F.transform(content_words(tx.lower_words(F.col(text))), lambda w: F.xxhash64(w))
    return df.select(*keep, F.explode(found).alias("w"))


@dataclass(frozen=True)
class CorpusModel:
    """Counts of a training corpus, kept as two tables below ``path``.

    ``words``: w, n, n_followed. ``pairs``: w, nxt, n; absent when fitted on words only.
    """

    path: str
    n_tokens: int
    n_words: int

    @classmethod
    def fit(cls, df: DataFrame, text: str, path: str | None = None, pairs: bool = True) -> CorpusModel:
        """Count ``df`` in one pass and write the tables; only two totals come to the driver."""
        spark = df.sparkSession
        path = path or scratch_path(spark, "corpus")
        if pairs:
            count_followed(df, text).write.parquet(f"{path}/pairs")
            counted = spark.read.parquet(f"{path}/pairs")
            followed = F.sum(F.when(F.col("nxt").isNotNull(), F.col("n")).otherwise(0))
            words = counted.groupBy("w").agg(F.sum("n").alias("n"), followed.alias("n_followed"))
        else:
            words = count_words(df, text).withColumn("n_followed", F.lit(0).cast("long"))
        words.write.parquet(f"{path}/words")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CorpusModel:
        words = spark.read.parquet(f"{path}/words").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        return cls(path, words[0], words[1])

    def _by_word(self, table: DataFrame, known: bool) -> DataFrame:
        """For the training corpus a table of its words is sent if they are few; for other texts its size at run time decides."""
        return F.broadcast(table) if known and self.n_words <= BROADCAST_WORDS else table

    def words(self, spark: SparkSession) -> DataFrame:
        """``(w, nll)``: hash and surprisal of the content words."""
        table = spark.read.parquet(f"{self.path}/words").filter(is_content_word(F.col("w")))
        return table.select(F.xxhash64("w").alias("w"), (-F.log(F.col("n") / F.lit(max(self.n_tokens, 1)))).alias("nll"))

    def pairs(self, spark: SparkSession, pairs: DataFrame | None = None) -> DataFrame:
        """``(h, nll)`` of distinct pairs, hashes ``h, v`` of both words and the first, or of the pairs of the training corpus."""
        read = lambda name: spark.read.parquet(f"{self.path}/{name}")
        followed = read("words").select(F.xxhash64("w").alias("v"), "n_followed")
        known = read("pairs").filter("nxt IS NOT NULL").select(F.xxhash64("w").alias("v"), F.xxhash64("nxt").alias("w"), "n")
        known = known.select(_pair_hash(F.col("v"), F.col("w")).alias("h"), "v", "n")
        found = known if pairs is None else pairs.join(known.select("h", "n"), "h", "left")
        zero = F.lit(0).cast("long")
        context = F.log((F.coalesce("n_followed", zero) + F.lit(max(self.n_words, 1))).cast("double"))
        value = context - F.log((F.coalesce("n", zero) + 1).cast("double"))
        return found.join(self._by_word(followed, pairs is None), "v", "left").select("h", value.alias("nll"))

    def score(self, df: DataFrame, text: str, keys, cwe: bool = True, ppl: bool = True, known: bool = False) -> DataFrame:
        """``(keys…, cwe, ppl)`` for every row of ``df``; ``keys`` tell the texts apart.

        ``known``: ``df`` is the training corpus, whose pairs need not be told apart again.
        """
        spark, keys = df.sparkSession, list(keys)
        zero, one = F.lit(0.0), F.lit(1).cast("long")
        parts = [df.select(*keys, zero.alias("nll"), F.lit(0).cast("long").alias("known_content"), zero.alias("pair_nll"),
                           F.lit(0).cast("long").alias("n_pairs"))]
        if cwe:
            rows = _content_hashes(df, text, *keys).join(self._by_word(self.words(spark), known), "w")
            parts.append(rows.select(*keys, "nll", one.alias("known_content")))
        if ppl:
            rows = _pair_hashes(df, text, *keys)
            values = self.pairs(spark, None if known else _pair_hashes(df, text, parts=True).distinct())
            parts.append(rows.join(values, "h").select(*keys, F.col("nll").alias("pair_nll"), one.alias("n_pairs")))
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        sums = stacked.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("nll", "known_content", "pair_nll", "n_pairs")])
        measures = []
        if cwe:
            measures.append(F.try_divide("nll", F.col("known_content").cast("double")).alias("cwe"))
        if ppl:
            measures.append(F.exp(F.try_divide("pair_nll", F.col("n_pairs").cast("double"))).alias("ppl"))
        return sums.select(*keys, *measures)
