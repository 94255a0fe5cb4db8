"""All subsets at once against single fits, brute force and laws."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from readgauge.operators import learn, stats, sweep

NAMES = ("low", "mid", "high")


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 5)) * [1, 10, 0.1, 1, 3] + [0, 100, 0, 5, 0]
    y = (x[:, 0] + 0.1 * (x[:, 1] - 100) + rng.normal(size=500) > 0).astype(int) + (x[:, 4] > 3)
    out = [[i, *map(float, v), int(c), i % 3 == 0] for i, (v, c) in enumerate(zip(x, y))]
    for i in range(0, 500, 7):
        out[i][3] = None
    out[11][6] = None
    for i in range(500):
        out[i][4] = 5.0  # one value only
    return out


@pytest.fixture(scope="module")
def data(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], "id int, a double, b double, c double, d double, e double, label int, is_test boolean").repartition(3).cache()


def brute_newton(x, y, steps=200):
    d, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    ridge = np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-d @ w))
        w -= np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + ridge, d.T @ (p - y) + ridge @ w)
    return w


@pytest.mark.parametrize("n_classes", [2, 3])
def test_each_subset_equals_its_own_fit(spark, data, rows, n_classes):
    df = data.withColumn("label", F.when(F.col("label") < n_classes, F.col("label")).when(F.col("label").isNotNull(), n_classes - 1))
    found = {tuple(r["feature_combination"]): r for r in sweep.logistic_sweep(df, list("abcde"), 2, NAMES[:n_classes]).collect()}
    assert list(found) == list(combinations("abcde", 2))
    table = np.array([[np.nan if v is None else float(v) for v in r[1:7]] + [float(r[7])] for r in rows])
    table[:, 5] = np.minimum(table[:, 5], n_classes - 1)
    for subset, record in found.items():
        own = ["abcde".index(f) for f in subset]
        keep = ~np.isnan(table[:, own + [5]]).any(axis=1)
        train, test = table[keep & (table[:, 6] == 0)], table[keep & (table[:, 6] == 1)]
        mean, scale = train[:, own].mean(axis=0), train[:, own].std(axis=0)
        scale[scale < 1e-12] = 1
        z = lambda t: (t[:, own] - mean) / scale
        targets = [1] if n_classes == 2 else range(3)
        w = [brute_newton(z(train), train[:, 5] == t) for t in targets]
        assert np.allclose(record["model_intercept"], [v[0] for v in w], atol=1e-6)
        assert np.allclose(record["model_coefficients"], [v[1:] for v in w], atol=1e-6)
        margins = np.column_stack([v[0] + z(test) @ v[1:] for v in w])
        guess = (margins[:, 0] > 0).astype(int) if n_classes == 2 else margins.argmax(axis=1)
        matrix = np.zeros((n_classes, n_classes), int)
        np.add.at(matrix, (test[:, 5].astype(int), guess), 1)
        assert record["confusion_matrix"] == matrix.tolist() and record["accuracy"] == pytest.approx(np.trace(matrix) / matrix.sum())


def test_sweep_agrees_with_the_library_fit(spark, data):
    two = data.withColumn("label", F.when(F.col("label") < 2, F.col("label")).when(F.col("label").isNotNull(), 1))
    swept = {tuple(r["feature_combination"]): r for r in sweep.logistic_sweep(two, list("abe"), 2, NAMES[:2]).collect()}
    for subset, record in swept.items():
        single = learn.logistic_record(two, subset, NAMES[:2])
        assert record["confusion_matrix"] == single["confusion_matrix"]
        assert record["model_coefficients"][0] == pytest.approx(single["model_coefficients"][0], abs=1e-3)


@pytest.mark.parametrize("run", [sweep.logistic_sweep, sweep.forest_sweep])
def test_sweep_goes_on_where_it_stopped(spark, data, tmp_path, monkeypatch, run):
    path, calls = str(tmp_path / "records"), []
    kept = sweep._confusions

    def lost(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("driver lost")
        return kept(*args)

    monkeypatch.setattr(sweep, "_confusions", lost)
    with pytest.raises(RuntimeError):
        run(data, list("abe"), 1, NAMES, group=1, path=path)
    found = run(data, list("abe"), 1, NAMES, group=1, path=path)
    assert [r["feature_combination"] for r in found.collect()] == [["a"], ["b"], ["e"]] and len(calls) == 4
    assert found.filter("error IS NOT NULL").isEmpty()


@pytest.mark.parametrize("run", [sweep.logistic_sweep, sweep.forest_sweep])
def test_subsets_without_rows_leave_an_error(spark, data, run):
    hollow = data.withColumn("a", F.lit(None).cast("double")).withColumn("b", F.when(~F.col("is_test"), F.col("b")))
    found = {r["feature_combination"][0]: r for r in run(hollow, list("abe"), 1, NAMES).collect()}
    assert found["a"]["error"] == "no complete training rows" and found["b"]["error"] == "no complete test rows"
    assert found["e"]["error"] is None and found["e"]["accuracy"] > 0.3
    assert all(r["error"] for r in run(hollow.limit(0), list("ae"), 1, NAMES).collect())


def test_one_class_only(spark, data):
    record = sweep.logistic_sweep(data.withColumn("label", F.lit(1)), ["a"], 1, NAMES[:2]).first()
    assert record["accuracy"] == 1.0 and record["model_intercept"] == [np.inf] and record["model_coefficients"] == [[0.0]]


def test_separable_rows_converge():
    x = np.array([[-2.0], [-1.0], [1.0], [2.0]] * 50)
    y = (x[:, 0] > 0).astype(float)
    d = np.c_[np.ones(len(x)), x * 50]

    def passes(models, w):
        out = []
        for v in w:
            t = d @ v
            p = 1 / (1 + np.exp(-np.clip(t, -700, 700)))
            out.append(np.concatenate([[len(x), np.logaddexp(0, t).sum() - t[y == 1].sum()], d.T @ (p - y), (d.T @ (d * (p * (1 - p))[:, None])).ravel()]))
        return np.array(out)

    w = sweep.newton(passes, 2, 1)
    p = 1 / (1 + np.exp(-d @ w[0]))
    assert np.allclose(d.T @ (p - y) + [0, w[0, 1]], 0, atol=1e-6) and np.allclose(w[0], w[1])


# --- forests


def brute_best_split(bins, y, weight, columns, n_classes):
    gini = lambda keep: (np.bincount(y[keep], weight[keep], n_classes) ** 2).sum() / weight[keep].sum()
    best = 1e-12
    for j in columns:
        for cut in range(bins[:, j].max()):
            low = bins[:, j] <= cut
            if weight[low].sum() and weight[~low].sum():
                best = max(best, gini(low) + gini(~low) - gini(np.ones(len(y), bool)))
    return best


def test_tree_takes_the_best_split():
    rng = np.random.default_rng(3)
    bins, y = rng.integers(0, 6, (80, 3)), rng.integers(0, 3, 80)
    y[bins[:, 1] > 3] = 2
    weight = rng.integers(0, 3, 80).astype(float)
    feature, cut, left, votes, gains = sweep.grow_tree(bins, y, weight, 3, np.random.default_rng(0), 1, 3, 6)
    assert gains.sum() == pytest.approx(brute_best_split(bins, y, weight, range(3), 3))
    low = bins[:, feature[0]] <= cut[0]
    assert np.allclose(votes[left[0]], np.bincount(y[low], weight[low], 3))
    assert np.allclose(votes[left[0] + 1], np.bincount(y[~low], weight[~low], 3))


def test_deep_tree_learns_its_rows():
    bins = np.array(list(np.ndindex(4, 4, 4)))
    y = (bins.sum(axis=1) % 2).astype(int)
    tree = sweep.grow_tree(bins, y, np.ones(64), 2, np.random.default_rng(1), 12, 3, 4)
    assert (sweep.vote([tree[:4]], bins) == y).all()
    assert len(tree[0]) > 10 and (tree[3][tree[0] < 0].max(axis=1) > 0).all()


def test_forest_sweep_learns(spark, data):
    two = data.withColumn("label", F.when(F.col("label") < 2, F.col("label")).when(F.col("label").isNotNull(), 1))
    first = sweep.forest_sweep(two, list("abe"), 2, NAMES[:2], group=2).collect()
    again = sweep.forest_sweep(two.repartition(5), list("abe"), 2, NAMES[:2], group=3).collect()
    assert first == again
    assert all(sum(r["feature_importances"]) == pytest.approx(1) for r in first)
    best = max(first, key=lambda r: r["accuracy"])
    assert best["accuracy"] > 0.65 and sum(map(sum, best["confusion_matrix"])) == 167


def test_training_sample_is_bounded_and_repeatable(spark, data):
    train = data.filter("NOT is_test AND label IS NOT NULL")
    whole = sweep.training_sample(train, list("ab"), "label", 10_000)
    part = sweep.training_sample(train, list("ab"), "label", 40)
    again = sweep.training_sample(train.repartition(7), list("ab"), "label", 40)
    assert len(whole) == train.count() and len(part) == 40
    assert sorted(map(tuple, part.to_numpy())) == sorted(map(tuple, again.to_numpy()))
