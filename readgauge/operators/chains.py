"""Roles of sentences in their order: a linear-chain conditional random field over hashed words and word pairs.

The score of a labelling adds, for each sentence, its label's weights of the sentence's features (each 1 / sqrt of their
number) and, for neighbours, the weight of the two labels in that order, with weights for the first and last label. Training
minimises the negative log-likelihood plus half ``penalty`` times the squared weights by L-BFGS. Each evaluation is one pass over the
stored chains: tasks run forward-backward on their chains and add up loss and gradient, whose size depends on ``buckets`` and the
number of labels only. All labelled sentences are trained on unless ``most`` is given; where there are many tasks, their sums are added up by
other tasks first, so that the driver gets few of them. Prediction takes the best labelling of each chain (Viterbi).

Sentences in rows of their own, ``(chain, position, text)``, are gathered in stretches of ``STRETCH`` positions, so a chain with a large
part of all rows spreads over many tasks; each stretch is a chain to the model. Sentences of one text in one row stay there
(``predict_arrays``). Rows with a null label are left out of training; a null text has no features; repeated positions keep the
order of their hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.measures import ratio
from ..session import scratch_path

BUCKETS = 1 << 15
STRETCH = 256
CELLS = 1 << 16
LIKE = 1.5
SLICE = 50_000
TINY = 1e-200  # far above what a double can hold, so that products of two are no zeros
SUMS = 16
SUM_SCHEMA = "part long, loss double, g binary"


def features(text: Column, buckets: int = BUCKETS) -> Column:
    """Distinct buckets of the lower-case words and neighbouring word pairs."""
    words = tx.lower_words(F.coalesce(text, F.lit("")))
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.transform(F.concat(words, pairs), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))


def stretches(sentences: DataFrame, chain: str, position: str, *carried: Column) -> DataFrame:
    """``_s``, one array per stretch: structs of position and the carried columns, in order."""
    rows = sentences.select(F.col(chain).alias("_chain"), F.floor(F.col(position) / STRETCH).alias("_stretch"),
                            F.struct(F.col(position).alias("pos"), *carried).alias("_x"))
    return rows.groupBy("_chain", "_stretch").agg(F.sort_array(F.collect_list("_x")).alias("_s"))


# --- one batch of chains in numpy


def emissions(weights: np.ndarray, found: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Scores of sentences by labels; ``found``: features of all sentences, ``begins``: where each sentence's begin."""
    out = np.zeros((len(begins) - 1, weights.shape[1]))
    sizes = np.diff(begins)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(weights[found], begins[some]) / np.sqrt(sizes[some])[:, None]
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def padded(scores: np.ndarray, chains: np.ndarray):
    """Groups of chains of like length: ``(sentence numbers of each chain and place, lengths, scores)``; numbers are -1 beyond the end."""
    sizes = np.diff(chains)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high + 1 - low) * sizes[order[high]] <= CELLS and sizes[order[high]] <= LIKE * sizes[order[low]] + 2:
            high += 1
        own = order[low:high]
        place = np.arange(sizes[own].max())
        at = np.where(place < sizes[own][:, None], chains[own][:, None] + place, -1)
        yield at, sizes[own], np.where((at >= 0)[:, :, None], scores[at], 0.0)
        low = high


def forward_backward(x: np.ndarray, sizes: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Of padded scores: log of the sum over all labellings, label probabilities, expected moves summed over places.

    Probabilities are scaled at each place, so there is one exponential a label and none a pair; scores too far apart for that are added as logarithms.
    """
    n, length, k = x.shape
    shift = moves.max()
    tops = x.max(axis=2)
    e, m = np.exp(x - tops[:, :, None]), np.exp(moves - shift)
    ending = np.exp(last - last.max())
    places = np.arange(length) < sizes[:, None]
    alpha, beta, scale = np.empty_like(x), np.empty_like(x), np.ones((n, length))
    alpha[:, 0] = np.exp(first - first.max()) * e[:, 0]
    scale[:, 0] = alpha[:, 0].sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha[:, 0] /= scale[:, 0, None]
        for t in range(1, length):
            going = places[:, t]
            step = (alpha[:, t - 1] @ m) * e[:, t]
            scale[:, t] = np.where(going, step.sum(axis=1), 1.0)
            alpha[:, t] = np.where(going[:, None], step / scale[:, t, None], alpha[:, t - 1])
        ends = alpha[:, -1] @ ending
        if not (scale.min() > TINY and ends.min() > TINY):  # also where one is not a number
            return _log_forward_backward(x, sizes, moves, first, last)
        beta[:, -1] = ending / ends[:, None]
        expected = np.zeros((k, k))
        for t in range(length - 2, -1, -1):
            going = places[:, t + 1]
            ahead = e[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]
            beta[:, t] = np.where(going[:, None], ahead @ m.T, beta[:, t + 1])
            expected += alpha[going, t].T @ ahead[going]
    total = (np.log(scale) + np.where(places, tops, 0.0)).sum(axis=1) + np.log(ends) + (sizes - 1) * shift + first.max() + last.max()
    return total, alpha * beta, expected * m


def _log_forward_backward(x: np.ndarray, sizes: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray):
    """The same as sums of logarithms, for scores of any range."""
    n, length, k = x.shape
    alpha, beta = np.empty_like(x), np.empty_like(x)
    alpha[:, 0] = first + x[:, 0]
    for t in range(1, length):
        going = (t < sizes)[:, None]
        alpha[:, t] = np.where(going, _logsum(alpha[:, t - 1][:, :, None] + moves, 1) + x[:, t], alpha[:, t - 1])
    total = _logsum(alpha[:, -1] + last, 1)
    beta[:, -1] = last
    expected = np.zeros((k, k))
    for t in range(length - 2, -1, -1):
        going = t + 1 < sizes
        ahead = (x[:, t + 1] + beta[:, t + 1])[:, None, :]
        beta[:, t] = np.where(going[:, None], _logsum(moves + ahead, 2), last)
        pair = alpha[:, t][:, :, None] + moves + ahead - total[:, None, None]
        expected += np.exp(pair[going]).sum(axis=0)
    return total, np.exp(alpha + beta - total[:, None, None]), expected


def loss_and_gradient(params: Params, found, begins, chains, labels):
    """Negative log-likelihood of the labels and its gradient, as flat numbers in the order of ``Params.flat``."""
    weights, moves, first, last = params.parts()
    k = len(first)
    scores = emissions(weights, found, begins)
    change = np.zeros_like(scores)
    d_moves, d_first, d_last, loss = np.zeros_like(moves), np.zeros(k), np.zeros(k), 0.0
    for at, sizes, x in padded(scores, chains):
        total, p, expected = forward_backward(x, sizes, moves, first, last)
        gold = np.where(at >= 0, labels[at], 0)
        inside, rows = at >= 0, np.arange(len(at))
        end = sizes - 1
        before, after = gold[:, :-1][inside[:, 1:]], gold[:, 1:][inside[:, 1:]]
        path = x[inside][np.arange(inside.sum()), gold[inside]].sum() + moves[before, after].sum()
        loss += total.sum() - path - first[gold[:, 0]].sum() - last[gold[rows, end]].sum()
        np.add.at(p, (*np.nonzero(inside), gold[inside]), -1.0)
        change[at[inside]] = p[inside]
        d_moves += expected
        np.add.at(d_moves, (before, after), -1.0)
        d_first += p[:, 0].sum(axis=0)
        d_last += p[rows, end].sum(axis=0)
    sizes = np.diff(begins)
    of = np.repeat(np.arange(len(sizes)), sizes)
    share = 1 / np.sqrt(np.maximum(sizes, 1))
    d_weights = np.column_stack([np.bincount(found, (change[:, j] * share)[of], len(weights)) for j in range(k)])
    return loss, np.concatenate([d_weights.ravel(), d_moves.ravel(), d_first, d_last])


def best_labels(params: Params, found, begins, chains) -> np.ndarray:
    """The label of each sentence in the best labelling of its chain; of equals the lower label."""
    weights, moves, first, last = params.parts()
    scores = emissions(weights, found, begins)
    out = np.zeros(len(scores), int)
    for at, sizes, x in padded(scores, chains):
        n, length, k = x.shape
        back = np.zeros((n, length, k), int)
        best = first + x[:, 0]
        for t in range(1, length):
            step = best[:, :, None] + moves
            going = (t < sizes)[:, None]
            back[:, t] = np.where(going, step.argmax(axis=1), np.arange(k))
            best = np.where(going, step.max(axis=1) + x[:, t], best)
        label, rows = (best + last).argmax(axis=1), np.arange(n)
        for t in range(length - 1, -1, -1):
            inside = t < sizes
            out[at[inside, t]] = label[inside]
            label = np.where(inside, back[rows, t, label], label)
    return out


@dataclass(frozen=True)
class Params:
    flat: np.ndarray
    buckets: int
    n_labels: int

    def parts(self):
        b, k = self.buckets * self.n_labels, self.n_labels
        moves = b + k * k
        return (self.flat[:b].reshape(self.buckets, k), self.flat[b:moves].reshape(k, k), self.flat[moves:moves + k], self.flat[moves + k:])

    @classmethod
    def zeros(cls, buckets: int, n_labels: int) -> Params:
        return cls(np.zeros(buckets * n_labels + n_labels ** 2 + 2 * n_labels), buckets, n_labels)


def lbfgs(evaluate: Callable, start: np.ndarray, passes: int = 60, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """Minimise; ``evaluate`` gives value and gradient and is called at most ``passes`` times."""
    x = start
    value, gradient = evaluate(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    used = 1
    while used < passes and np.abs(gradient).max() > tolerance * max(1.0, np.abs(x).max()):
        direction, kept = gradient.copy(), []
        for s, y in reversed(steps):
            a = (s @ direction) / (s @ y)
            direction -= a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction /= max(1.0, np.abs(direction).max())
        for (s, y), a in zip(steps, reversed(kept)):
            direction += s * (a - (y @ direction) / (s @ y))
        size, slope = 1.0, -(gradient @ direction)
        while used < passes:
            used += 1
            trial = x - size * direction
            new_value, new_gradient = evaluate(trial)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return x
        s, y = trial - x, new_gradient - gradient
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        x, value, gradient = trial, new_value, new_gradient
    return x


# --- on Spark


def _arrays(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From an array of arrays of features: all features, where sentences begin, where chains begin."""
    sentences = column.flatten()
    begins = np.concatenate([[0], np.cumsum(sentences.value_lengths().fill_null(0).to_numpy())])
    chains = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
    return sentences.flatten().to_numpy().astype(np.int64), begins, chains


def _sliced(batch, column: str):
    """Parts of a batch of at most about ``SLICE`` sentences: many chains at once, so that those of like length meet."""
    upto = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy())
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + SLICE, "right")))
        yield batch.slice(low, high - low)
        low = high


@dataclass(frozen=True)
class RoleChain:
    params: Params
    labels: tuple[str, ...]

    @classmethod
    def fit(cls, sentences: DataFrame, chain: str, position: str, text: str, label: str, buckets: int = BUCKETS, penalty: float = 0.1,
            passes: int = 60, most: int | None = None) -> RoleChain:
        """Labels are in the order of their names. All sentences are trained on; with ``most`` about so many, whole stretches chosen by hash."""
        spark = sentences.sparkSession
        known = sentences.filter(F.col(label).isNotNull())
        each = {r[0]: r[1] for r in known.groupBy(label).agg(F.count("*")).collect()}
        labels = sorted(each)
        if not labels:
            raise ValueError("no labelled sentences")
        n = sum(each.values())
        if most is not None and n > most:
            known = known.filter(F.pmod(F.xxhash64(chain, F.floor(F.col(position) / STRETCH)), F.lit(1 << 20)) < int((1 << 20) * most / n))
        number = F.coalesce(*[F.when(F.col(label) == x, F.lit(i)) for i, x in enumerate(labels)])
        path = scratch_path(spark, "chains")
        gathered = stretches(known, chain, position, number.alias("y"), features(F.col(text), buckets).alias("f"))
        gathered.select(F.col("_s.f").alias("f"), F.col("_s.y").alias("y")).write.parquet(path)
        rows = spark.read.parquet(path)
        n_tasks = rows.rdd.getNumPartitions()
        sums = max(SUMS, isqrt(n_tasks))
        start = Params.zeros(buckets, len(labels))
        size = len(start.flat)

        def add_up(batches):
            """In the order of the tasks that made them, whichever comes first."""
            parts = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda r: r["part"])
            loss, gradient = 0.0, np.zeros(size)
            for r in parts:
                loss, gradient = loss + r["loss"], gradient + np.frombuffer(r["g"])
            if parts:
                yield pa.RecordBatch.from_pydict({"part": [parts[0]["part"]], "loss": [loss], "g": [gradient.tobytes()]})

        def evaluate(flat):
            given = spark.sparkContext.broadcast(Params(flat, buckets, len(labels)))

            def add(batches):
                loss, gradient = 0.0, np.zeros(size)
                for batch in batches:
                    for part in _sliced(batch, "f"):
                        own, change = loss_and_gradient(given.value, *_arrays(part.column("f")), part.column("y").flatten().to_numpy())
                        loss, gradient = loss + own, gradient + change
                yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "loss": [loss], "g": [gradient.tobytes()]})

            parts = rows.mapInArrow(add, SUM_SCHEMA)
            if n_tasks > sums:
                parts = parts.repartition(sums, F.floor(F.col("part") * sums / n_tasks)).mapInArrow(add_up, SUM_SCHEMA)
            loss, gradient = 0.5 * penalty * flat @ flat, penalty * flat
            for part in sorted(parts.collect(), key=lambda r: r["part"]):
                loss, gradient = loss + part["loss"], gradient + np.frombuffer(part["g"])
            given.unpersist()
            return loss, gradient

        return cls(Params(lbfgs(evaluate, start.flat, passes), buckets, len(labels)), tuple(labels))

    def predict(self, sentences: DataFrame, chain: str, position: str, text: str, *keep: str, out: str = "role") -> DataFrame:
        """``chain, position``, the kept columns and the role, one row per given row."""
        carried = [F.col(c).alias(c) for c in keep]
        gathered = stretches(sentences, chain, position, features(F.col(text), self.params.buckets).alias("f"), *carried)
        labelled = self.predict_arrays(gathered.withColumn("_f", F.col("_s.f")), "_f", "_r")
        rows = labelled.select("_chain", F.explode(F.arrays_zip("_s", "_r")).alias("x"))
        return rows.select(F.col("_chain").alias(chain), F.col("x._s.pos").alias(position),
                           *[F.col(f"x._s.{c}").alias(c) for c in keep], F.col("x._r").alias(out))

    def predict_arrays(self, df: DataFrame, feature_arrays: str, out: str) -> DataFrame:
        """Adds the roles of each row's sentences, given their features as an array of arrays; nothing is shuffled."""
        given = df.sparkSession.sparkContext.broadcast(self)
        names = list(df.columns)
        schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])

        def label(batches):
            model = given.value
            words = pa.array(model.labels, pa.string())
            for batch in batches:
                for part in _sliced(batch, feature_arrays):
                    found, begins, chains = _arrays(part.column(feature_arrays))
                    best = words.take(pa.array(best_labels(model.params, found, begins, chains)))
                    roles = pa.ListArray.from_arrays(pa.array(chains, pa.int32()), best)
                    yield pa.RecordBatch.from_arrays([*part.columns, roles], [*names, out])

        return df.mapInArrow(label, schema)


def section_role_ratios(pairs: DataFrame, model: RoleChain, sections=("abstract", "summary"), split=tx.sentences) -> DataFrame:
    """``doc_id`` and per section the share of sentences of each role, as ``feature_table(roles=…)`` takes them."""
    df = pairs.select("doc_id", *sections)
    for s in sections:
        found = F.transform(split(F.col(s)), lambda x: features(x, model.params.buckets))
        df = model.predict_arrays(df.withColumn(f"_{s}", found), f"_{s}", f"_{s}_roles").drop(f"_{s}")

    def share(section: str, role: str) -> Column:
        roles = F.col(f"_{section}_roles")
        return ratio(F.size(F.filter(roles, lambda r: r == F.lit(role))), F.size(roles)).alias(f"{section}_{role}_ratio")

    return df.select("doc_id", *[share(s, x) for s in sections for x in model.labels])
