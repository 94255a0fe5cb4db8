"""All feature subsets at once: logistic models by shared Newton passes, forests of a bounded sample, one scoring pass.

``logistic_sweep`` fits every subset's model on all its complete training rows. A pass over the rows sums, for each model that has
not converged, loss, gradient and curvature at its present coefficients. Tasks add up their rows, a grouping by model adds up
the tasks, and a few numbers per model come to the driver, which takes the Newton steps. A step that does not lower the loss is
halved. Rows are standardised by the means and deviations of the subset's own training rows, so each model is the one that
``learn.logistic_record`` fits. Models go in groups of ``GROUP``, so that what is sent to the tasks is bounded.

``forest_sweep`` grows each subset's forest in one task from the same at most ``sample_rows`` training rows, those with the lowest
hash; subsets spread over the cluster. All test rows are scored, in one pass for each group of forests.

A subset without complete rows in either part leaves a record with an ``error``; so does a failing fit. Rows with a null label count
for nothing. With ``path`` each group's records are appended there, and subsets that have a result there are not fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.results import read_results
from .learn import feature_subsets, records_table
from .stats import hash_number

GROUP = 2048
FOREST_GROUP = 128
MAX_PASSES = 100
TOLERANCE = 1e-18  # of the squared Newton decrement over the number of rows
ROWS = 8192
SAMPLE_ROWS = 20_000
BINS = 32


def _blocks(batches, n_features: int, rows: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(features, labels)`` of rows put together to blocks; nulls are NaN."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            part = batch.slice(low, rows)
            columns = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in part.columns]
            yield np.column_stack(columns[:n_features]) if n_features else None, columns[n_features].astype(np.int64)


def _summed(df: DataFrame, features, label: str, sums, n_models: int, width: int) -> np.ndarray:
    """``sums(x, y)``, an array of models by ``width``, added up over all rows of ``df``."""
    names = [f"v{i}" for i in range(width)]

    def partial(batches):
        total = np.zeros((n_models, width))
        for x, y in _blocks(batches, len(features)):
            total += sums(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_models, dtype=np.int32)), *map(pa.array, total.T.copy())], ["m", *names])

    columns = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("long").alias("_y"))
    parts = columns.filter("_y IS NOT NULL").mapInArrow(partial, "m int, " + ", ".join(f"{n} double" for n in names))
    rows = parts.groupBy("m").agg(*[F.sum(n).alias(n) for n in names]).toPandas().sort_values("m")
    out = np.zeros((n_models, width))
    out[rows["m"].to_numpy()] = rows[names].to_numpy()
    return out


def _moments(train: DataFrame, features, label: str, columns: np.ndarray, n_classes: int, around: np.ndarray):
    """Per subset: rows of each class, and mean and deviation of its columns over its complete rows."""
    k = columns.shape[1]

    def sums(x, y):
        x = x - around
        bad = np.isnan(x)
        clean = np.where(bad, 0, x)
        out = np.zeros((len(columns), n_classes + 2 * k))
        whole = None if bad.any() else (clean.sum(axis=0), (clean * clean).sum(axis=0), np.bincount(y, minlength=n_classes))
        for m, own in enumerate(columns):
            if whole:
                out[m] = np.concatenate([whole[2], whole[0][own], whole[1][own]])
                continue
            keep = ~bad[:, own].any(axis=1)
            part = clean[np.ix_(keep, own)]
            out[m] = np.concatenate([np.bincount(y[keep], minlength=n_classes), part.sum(axis=0), (part * part).sum(axis=0)])
        return out

    found = _summed(train, features, label, sums, len(columns), n_classes + 2 * k)
    counts = found[:, :n_classes]
    n = np.maximum(counts.sum(axis=1), 1)[:, None]
    mean = found[:, n_classes:n_classes + k] / n
    variance = found[:, n_classes + k:] / n - mean * mean
    scale = np.sqrt(np.where(variance > 1e-13 * (mean * mean + 1e-300), variance, 0))
    return counts, mean + around[columns], np.where(scale > 0, scale, 1.0)


def _design(x: np.ndarray, own, mean, scale) -> tuple[np.ndarray, np.ndarray]:
    """Standardised columns with a leading 1, and which rows are complete; others are 0 throughout."""
    z = (x[:, own] - mean) / scale
    keep = ~np.isnan(z).any(axis=1)
    return np.column_stack([keep, np.where(keep[:, None], z, 0.0)]).astype(float), keep


def newton(passes, n_models: int, k: int, penalty: float = 1.0, max_passes: int = MAX_PASSES) -> np.ndarray:
    """Coefficients (intercept first) of all models.

    ``passes(models, w)`` gives rows of ``n, loss, gradient, curvature`` of the unpenalised sums at ``w`` for the given models.
    """
    w, best = np.zeros((n_models, k + 1)), np.full(n_models, np.inf)
    trial, open_models = w.copy(), np.arange(n_models)
    ridge = np.diag([0.0] + [penalty] * k)
    for _ in range(max_passes):
        if not len(open_models):
            break
        sums = passes(open_models, trial[open_models])
        still = []
        for m, row in zip(open_models, sums):
            at = trial[m]
            loss = row[1] + 0.5 * at @ ridge @ at
            if loss > best[m] + 1e-12 * abs(best[m]):
                if np.abs(at - w[m]).max() > 1e-12:  # too far: half the step
                    trial[m] = (at + w[m]) / 2
                    still.append(m)
                continue
            w[m], best[m] = at, loss
            gradient = row[2:3 + k] + ridge @ at
            curvature = row[3 + k:].reshape(k + 1, k + 1) + ridge
            step = np.linalg.lstsq(curvature, gradient, rcond=1e-12)[0]
            if gradient @ step > TOLERANCE * max(row[0], 1):
                trial[m] = at - step
                still.append(m)
        open_models = np.array(still, int)
    return w


def fit_logistic_models(train: DataFrame, features, label: str, columns: np.ndarray, targets: np.ndarray, mean, scale) -> np.ndarray:
    """One binary model per row of ``columns`` (its features), ``targets`` (its class against the rest)."""
    k = columns.shape[1]

    def passes(models, w):
        own, target, mu, sd = columns[models], targets[models], mean[models], scale[models]

        def sums(x, y):
            out = np.zeros((len(own), 2 + (k + 1) + (k + 1) ** 2))
            for m in range(len(own)):
                d, keep = _design(x, own[m], mu[m], sd[m])
                t = d @ w[m]
                hit = (y == target[m]) & keep
                p = 1 / (1 + np.exp(-np.clip(t, -700, 700)))
                loss = (np.logaddexp(0, t) * keep).sum() - t[hit].sum()
                out[m, 0], out[m, 1] = keep.sum(), loss
                out[m, 2:3 + k] = d.T @ (p - hit)
                out[m, 3 + k:] = (d.T @ (d * (p * (1 - p))[:, None])).ravel()
            return out

        return _summed(train, features, label, sums, len(own), 2 + (k + 1) + (k + 1) ** 2)

    return newton(passes, len(columns), k)


def _confusions(test: DataFrame, features, label: str, predict, n_models: int, n_classes: int) -> np.ndarray:
    """``predict(x, m)`` gives classes, -1 for incomplete rows; counts by model, class and predicted class."""
    def sums(x, y):
        out = np.zeros((n_models, n_classes * n_classes))
        for m in range(n_models):
            found = predict(x, m)
            keep = found >= 0
            out[m] = np.bincount(y[keep] * n_classes + found[keep], minlength=n_classes * n_classes)
        return out

    return _summed(test, features, label, sums, n_models, n_classes ** 2).reshape(n_models, n_classes, n_classes).round().astype(int)


def _record(subset, matrix, class_labels, **model) -> dict:
    total = int(matrix.sum())
    if not total:
        return {"feature_combination": list(subset), "error": "no complete test rows"}
    return {"feature_combination": list(subset), "confusion_matrix": matrix.tolist(), "accuracy": int(np.trace(matrix)) / total,
            "class_labels": list(class_labels), **model}


def _stored(df: DataFrame, features, label: str, test_flag: str) -> DataFrame:
    """The needed columns, written once for all passes."""
    path = scratch_path(df.sparkSession, "sweep-rows")
    df.select(*features, label, test_flag).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _in_groups(spark, subsets, size: int, path, run) -> DataFrame:
    known = {}
    if path:
        records_table(spark, []).write.mode("append").json(path)
        known = {tuple(r["feature_combination"]): r.asDict() for r in read_results(spark, path).filter("error IS NULL").collect()}
    todo = [s for s in subsets if s not in known]
    for low in range(0, len(todo), size):
        records = run(todo[low:low + size])
        if path:
            records_table(spark, records).write.mode("append").json(path)
        known |= {tuple(r["feature_combination"]): r for r in records}
    return records_table(spark, [known[s] for s in subsets])


def logistic_sweep(df: DataFrame, features, k: int, class_labels, label: str = "label", test_flag: str = "is_test",
                   group: int = GROUP, path: str | None = None) -> DataFrame:
    """One record per subset of ``k`` features, as ``learn.logistic_record`` makes it, from a few passes over the rows."""
    spark, features, n_classes = df.sparkSession, list(features), len(class_labels)
    rows = _stored(df, features, label, test_flag)
    train, test = rows.filter(~F.col(test_flag)), rows.filter(F.col(test_flag))
    centre = train.agg(*[F.coalesce(F.avg(f), F.lit(0.0)).alias(f) for f in features]).first()
    around = np.array([float(centre[f]) for f in features])
    targets = [1] if n_classes == 2 else list(range(n_classes))

    def run(subsets):
        columns = np.array([[features.index(f) for f in s] for s in subsets])
        counts, mean, scale = _moments(train, features, label, columns, n_classes, around)
        models = [(i, t) for i in range(len(subsets)) for t in targets]
        w = np.zeros((len(subsets), len(targets), k + 1))
        for i, t in models:  # a class that all rows or none belong to needs no fit
            if counts[i, t] in (0, counts[i].sum()):
                w[i, targets.index(t), 0] = np.inf if counts[i, t] else -np.inf
        fitted = [(i, t) for i, t in models if np.isfinite(w[i, targets.index(t), 0])]
        if fitted:
            of, target = (np.array(x) for x in zip(*fitted))
            found = fit_logistic_models(train, features, label, columns[of], target, mean[of], scale[of])
            w[of, [targets.index(t) for t in target]] = found

        def predict(x, m):
            d, keep = _design(x, columns[m], mean[m], scale[m])
            margins = d[:, 1:] @ w[m, :, 1:].T + w[m, :, 0]
            best = (margins[:, 0] > 0).astype(int) if n_classes == 2 else margins.argmax(axis=1)
            return np.where(keep, best, -1)

        matrices = _confusions(test, features, label, predict, len(subsets), n_classes)
        return [
            {"feature_combination": list(s), "error": "no complete training rows"} if not counts[i].sum() else
            _record(s, matrices[i], class_labels, model_coefficients=w[i, :, 1:].tolist(), model_intercept=w[i, :, 0].tolist())
            for i, s in enumerate(subsets)
        ]

    return _in_groups(spark, feature_subsets(features, k), group, path, run)


# --- forests


def grow_tree(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, n_classes: int, rng, max_depth: int, tries: int, n_bins: int):
    """A tree over binned columns, level by level: arrays ``feature`` (-1: leaf), ``cut`` (bins up to it go left), ``left``, ``votes``.

    Each node of several classes tries ``tries`` columns, in random order and leaving out those that have one value there, and
    takes the split of greatest Gini gain, which may be 0. Also the gain that each column brought.
    """
    n_columns = bins.shape[1]
    gains, rows, node = np.zeros(n_columns), np.flatnonzero(weight > 0), np.zeros(int((weight > 0).sum()), int)
    votes = np.bincount(y, weight, n_classes)[None, :]
    levels, n_nodes = [], 1
    for depth in range(max_depth + 1):
        size = len(votes)
        best_gain, best, tried = np.full(size, -np.inf), np.full((size, 2), -1), np.zeros(size, int)
        chosen = rng.random((size, n_columns)).argsort(axis=1)
        mixed = votes.max(axis=1) < votes.sum(axis=1)
        for j in range(n_columns if depth < max_depth and mixed.any() else 0):
            column = chosen[node, j]
            code = (node * n_bins + bins[rows, column]) * n_classes + y[rows]
            low = np.bincount(code, weight[rows], size * n_bins * n_classes).reshape(size, n_bins, n_classes).cumsum(axis=1)
            high = votes[:, None, :] - low
            n_low, n_high, n = low.sum(axis=2), high.sum(axis=2), votes.sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (low ** 2).sum(axis=2) / n_low + (high ** 2).sum(axis=2) / n_high - ((votes ** 2).sum(axis=1) / n)[:, None]
            gain[(n_low == 0) | (n_high == 0)] = -np.inf
            at = gain.argmax(axis=1)
            top = gain[np.arange(size), at]
            usable = np.isfinite(top) & (tried < tries) & mixed
            better = usable & (top > best_gain)
            best_gain[better] = top[better]
            best[better] = np.column_stack([chosen[:, j], at])[better]
            tried += usable
            if (tried >= tries)[mixed].all():
                break
        split = np.flatnonzero(best[:, 0] >= 0)
        first = np.zeros(size, int)  # children stand side by side, in the order of their parents
        first[split] = n_nodes + 2 * np.arange(len(split))
        levels.append((best[:, 0], best[:, 1], first, votes))
        if not len(split):
            break
        np.add.at(gains, best[split, 0], np.maximum(best_gain[split], 0.0))
        keep = best[node, 0] >= 0
        rows, old = rows[keep], node[keep]
        node = first[old] - n_nodes + (bins[rows, best[old, 0]] > best[old, 1])
        n_nodes += 2 * len(split)
        votes = np.bincount(node * n_classes + y[rows], weight[rows], 2 * len(split) * n_classes).reshape(-1, n_classes)
    return (*(np.concatenate(x) for x in zip(*levels)), gains)


def grow_forest(bins, y, n_classes: int, trees: int, max_depth: int, seed: int, n_bins: int):
    """``(trees, importances)``: trees of bootstrapped rows, each a tuple of arrays; importances add up to 1 or are all 0."""
    tries = max(1, int(np.sqrt(bins.shape[1])))
    out, importances = [], np.zeros(bins.shape[1])
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        weight = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        *tree, gains = grow_tree(bins, y, weight, n_classes, rng, max_depth, tries, n_bins)
        out.append(tree)
        importances += gains / gains.sum() if gains.sum() else 0
    return out, importances / importances.sum() if importances.sum() else importances


def vote(forest, bins: np.ndarray) -> np.ndarray:
    """The class of the greatest mean share of votes, the lowest of equals."""
    total = 0.0
    for feature, cut, left, votes in forest:
        at = np.zeros(len(bins), int)
        moving = feature[at] >= 0
        while moving.any():
            f = feature[at]
            following = left[at] + (bins[np.arange(len(bins)), np.maximum(f, 0)] > cut[at])
            at = np.where(moving, following, at)
            moving = feature[at] >= 0
        total = total + (votes / votes.sum(axis=1, keepdims=True))[at]
    return np.round(total, 9).argmax(axis=1)


def _edges(values: np.ndarray, n_bins: int) -> np.ndarray:
    """At most ``n_bins - 1`` upper edges of bins of about equal numbers."""
    values = np.sort(values)
    return np.unique(values[(np.arange(1, n_bins) * len(values)) // n_bins]) if len(values) else np.zeros(0)


def training_sample(train: DataFrame, features, label: str, rows: int, seed: int = 42) -> pd.DataFrame:
    """The ``rows`` training rows of lowest hash over their values; equal rows tie and are alike."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in (*features, label)])
    n = train.count()
    if n > rows:  # a bound on the hash that a little more than the wanted rows meet, then the lowest of these
        near = min(1.0, rows / n * 1.2 + 10 / rows)
        train = train.withColumn("_h", hash_number(key, seed)).filter(F.col("_h") <= int(near * 2**32)).orderBy("_h").limit(rows)
    return train.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("long").alias("_y")).toPandas()


def forest_sweep(df: DataFrame, features, k: int, class_labels, label: str = "label", test_flag: str = "is_test",
                 trees: int = 20, max_depth: int = 8, seed: int = 42, sample_rows: int = SAMPLE_ROWS, bins: int = BINS,
                 group: int = FOREST_GROUP, path: str | None = None) -> DataFrame:
    """One record per subset of ``k`` features: a forest of the training sample, scored on all test rows."""
    spark, features, n_classes = df.sparkSession, list(features), len(class_labels)
    rows = _stored(df, features, label, test_flag)
    train, test = rows.filter(~F.col(test_flag) & F.col(label).isNotNull()), rows.filter(F.col(test_flag))
    sample = training_sample(train, features, label, sample_rows, seed)
    x, y = sample[features].to_numpy(float), sample["_y"].to_numpy()
    order = np.lexsort([y, *np.nan_to_num(x.T, nan=np.inf)])  # independent of the order in which rows came
    x, y = x[order], y[order]
    missing = np.isnan(x)
    edges = [_edges(x[~missing[:, j], j], bins) for j in range(len(features))]

    def binned(values):
        return np.column_stack([np.searchsorted(e, values[:, j], "left") for j, e in enumerate(edges)])

    data = spark.sparkContext.broadcast((binned(x), y, missing))

    def run(subsets):
        columns = [[features.index(f) for f in s] for s in subsets]

        def grow(batches):
            codes, y, missing = data.value
            for batch in batches:
                for m in batch.column("id").to_pylist():
                    keep = ~missing[:, columns[m]].any(axis=1)
                    if not keep.any():
                        continue
                    forest, gain = grow_forest(codes[np.ix_(keep, columns[m])], y[keep], n_classes, trees, max_depth, seed, bins)
                    yield pa.RecordBatch.from_pydict({
                        "m": [m], "importances": [gain.tolist()],
                        **{name: [[t[i].ravel().tolist() for t in forest]] for i, name in enumerate(("feature", "cut", "left", "votes"))},
                    }, schema=GROWN)

        ids = spark.range(len(subsets), numPartitions=min(len(subsets), 4 * spark.sparkContext.defaultParallelism))
        grown = ids.mapInArrow(grow, "m int, importances array<double>, feature array<array<int>>, cut array<array<int>>, "
                                     "left array<array<int>>, votes array<array<double>>").collect()
        forests, gains = {}, {}
        for row in grown:
            gains[row["m"]] = list(row["importances"])
            forests[row["m"]] = [
                (np.array(f), np.array(c), np.array(left), np.array(v).reshape(-1, n_classes))
                for f, c, left, v in zip(row["feature"], row["cut"], row["left"], row["votes"])]

        def predict(values, m):
            own = columns[m]
            keep = ~np.isnan(values[:, own]).any(axis=1)
            if m not in forests:
                return np.full(len(values), -1)
            codes = np.column_stack([np.searchsorted(edges[j], values[:, j], "left") for j in own])
            return np.where(keep, vote(forests[m], codes), -1)

        matrices = _confusions(test, features, label, predict, len(subsets), n_classes)
        return [
            _record(s, matrices[m], class_labels, feature_importances=gains[m]) if m in forests else
            {"feature_combination": list(s), "error": "no complete training rows"}
            for m, s in enumerate(subsets)
        ]

    return _in_groups(spark, feature_subsets(features, k), group, path, run)


GROWN = pa.schema([
    ("m", pa.int32()), ("importances", pa.list_(pa.float64())), ("feature", pa.list_(pa.list_(pa.int32()))),
    ("cut", pa.list_(pa.list_(pa.int32()))), ("left", pa.list_(pa.list_(pa.int32()))), ("votes", pa.list_(pa.list_(pa.float64()))),
])
