"""The conditional random field against enumeration of all labellings, numerical gradients and an order-only task."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from readgauge.functions import lexicon
from readgauge.operators import chains, metrics, roles, stats
from readgauge.plans import views
from readgauge.plans.feature_table import feature_table


def example(seed=0, buckets=6, k=3):
    rng = np.random.default_rng(seed)
    sizes = [1, 4, 0, 3, 5, 1]
    found, begins, labels = [], [0], []
    for _ in range(sum(sizes)):
        own = rng.choice(buckets, rng.integers(0, 4), replace=False)
        found += own.tolist()
        begins.append(len(found))
        labels.append(int(rng.integers(0, k)))
    params = chains.Params(rng.normal(size=len(chains.Params.zeros(buckets, k).flat)), buckets, k)
    return params, np.array(found), np.array(begins), np.concatenate([[0], np.cumsum(sizes)]), np.array(labels)


def path_score(params, found, begins, first, last, labels):
    weights, moves, head, tail = params.parts()
    total = head[labels[0]] + tail[labels[-1]] + sum(moves[a, b] for a, b in zip(labels, labels[1:]))
    for s, y in zip(range(first, last), labels):
        own = found[begins[s]:begins[s + 1]]
        total += weights[own, y].sum() / np.sqrt(len(own)) if len(own) else 0
    return total


@pytest.mark.parametrize("cells", [1, 1 << 16])
def test_likelihood_and_best_labels_by_enumeration(monkeypatch, cells):
    monkeypatch.setattr(chains, "CELLS", cells)
    params, found, begins, ends, labels = example()
    want, best = 0.0, np.zeros(len(labels), int)
    for a, b in zip(ends, ends[1:]):
        if a < b:
            scores = {y: path_score(params, found, begins, a, b, y) for y in product(range(3), repeat=b - a)}
            want += np.log(sum(np.exp(v) for v in scores.values())) - scores[tuple(labels[a:b])]
            best[a:b] = max(scores, key=scores.get)
    loss, _ = chains.loss_and_gradient(params, found, begins, ends, labels)
    assert loss == pytest.approx(want)
    assert (chains.best_labels(params, found, begins, ends) == best).all()


def test_gradient_is_the_slope():
    params, *rest = example(3)
    _, gradient = chains.loss_and_gradient(params, *rest)
    for i in range(len(params.flat)):
        step = np.zeros(len(params.flat))
        step[i] = 1e-5
        up, down = (chains.loss_and_gradient(chains.Params(params.flat + s, params.buckets, 3), *rest)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_lbfgs_finds_the_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    b = np.array([1.0, -2.0, 3.0])
    x = chains.lbfgs(lambda v: (0.5 * v @ a @ v - b @ v, a @ v - b), np.zeros(3), passes=100, tolerance=1e-9)
    assert np.allclose(x, np.linalg.solve(a, b), atol=1e-6)


@pytest.fixture(scope="module")
def ordered(spark):
    """Labels go round a, b, c; only the first word of a chain tells where, all others say nothing."""
    rng = np.random.default_rng(2)
    rows = []
    for c in range(120):
        at = int(rng.integers(0, 3))
        for t in range(int(rng.integers(1, 9))):
            word = "xyz"[(at + t) % 3] if t == 0 else "w"
            rows.append((c, t * 2, f"{word} filler", "abc"[(at + t) % 3], c % 3 == 0))
    rows.append((500, 0, None, "a", False))
    rows.append((501, 0, "lost", None, False))
    return spark.createDataFrame(rows, "c int, t int, s string, y string, test boolean").repartition(4).cache()


def test_order_is_learned(spark, ordered):
    model = chains.RoleChain.fit(ordered.filter("NOT test"), "c", "t", "s", "y", buckets=1 << 10)
    test = ordered.filter("test")
    got = model.predict(test, "c", "t", "s", "y")
    assert got.columns == ["c", "t", "y", "role"] and got.count() == test.count()
    assert got.agg(F.avg((F.col("y") == F.col("role")).cast("int"))).first()[0] == 1.0
    bag = roles.fit_role_classifier(ordered.filter("NOT test AND s IS NOT NULL AND y IS NOT NULL"), "s", "y")
    flat = roles.predict_roles(bag, test)
    assert flat.agg(F.avg((F.col("y") == F.col("role")).cast("int"))).first()[0] < 0.8


def test_long_chains_are_cut_into_stretches(spark, ordered, monkeypatch):
    monkeypatch.setattr(chains, "STRETCH", 4)
    pieces = chains.stretches(ordered, "c", "t").collect()
    assert max(len(r["_s"]) for r in pieces) <= 2 and sum(len(r["_s"]) for r in pieces) == ordered.count()
    assert all([x["pos"] for x in r["_s"]] == sorted(x["pos"] for x in r["_s"]) for r in pieces)


def test_no_labels_is_an_error(spark, ordered):
    with pytest.raises(ValueError):
        chains.RoleChain.fit(ordered.filter("y IS NULL"), "c", "t", "s", "y")


def test_sample_takes_whole_stretches(spark, ordered):
    model = chains.RoleChain.fit(ordered, "c", "t", "s", "y", buckets=64, passes=3, most=100)
    assert model.labels == ("a", "b", "c") and np.isfinite(model.params.flat).all()


def test_better_than_the_bag_on_held_out_turns(spark):
    turns = views.turns(spark, "/root/testdata/sf0.01")
    held = stats.in_test(F.col("abstract_id"), 0.3)
    model = chains.RoleChain.fit(turns.filter(~held), "abstract_id", "pos", "sentence", "label", passes=30)
    ours = model.predict(turns.filter(held), "abstract_id", "pos", "sentence", "label")
    bag = roles.predict_roles(roles.fit_role_classifier(turns.filter(~held)), turns.filter(held))
    share = lambda df: metrics.accuracy(df, "label", "role").first()[0]
    assert share(ours) > share(bag)


def test_ratios_feed_the_feature_table(spark):
    sentences = spark.createDataFrame([
        (i, t, f"{w} {w} thing", r) for i in range(12) for t, (w, r) in enumerate(zip("vwxyz", lexicon.ROLES))], "c int, t int, s string, y string")
    model = chains.RoleChain.fit(sentences, "c", "t", "s", "y", buckets=1 << 10)
    pairs = spark.createDataFrame([("p", "V v. W w. X x. Y y. Z z.", "Z thing."), ("q", "", None)], "doc_id string, abstract string, summary string")
    ratios = chains.section_role_ratios(pairs, model)
    table = {r["doc_id"]: r for r in feature_table(pairs, roles=ratios).collect()}
    assert [table["p"][f"abstract_{r}_ratio"] for r in lexicon.ROLES] == [pytest.approx(0.2)] * 5
    assert sum(table["p"][f"summary_{r}_ratio"] for r in lexicon.ROLES) == pytest.approx(1)
    assert all(table["q"][f"{s}_{r}_ratio"] == 0 for s in ("abstract", "summary") for r in lexicon.ROLES)


def test_all_sentences_are_trained_on(spark, monkeypatch):
    """Without weights a sentence loses ln of the number of labels, so the first loss tells how many there are; sums of sums are the same."""
    rows = spark.range(60_000, numPartitions=4).selectExpr(
        "CAST(id / 7 AS INT) AS c", "CAST(id % 7 AS INT) AS t", "concat('w', id % 50) AS s", "concat('l', id % 3) AS y")
    first = {}
    monkeypatch.setattr(chains, "lbfgs", lambda evaluate, flat, passes: first.setdefault(chains.SUMS, evaluate(flat)) and flat)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        for sums in (16, 1):
            monkeypatch.setattr(chains, "SUMS", sums)
            chains.RoleChain.fit(rows, "c", "t", "s", "y", buckets=64)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first[16][0] == pytest.approx(60_000 * math.log(3)) == first[1][0]
    assert np.allclose(first[16][1], first[1][1])


@pytest.mark.parametrize("spread", [1.0, 30.0, 900.0])
def test_scaled_sums_equal_sums_of_logarithms(spread):
    rng = np.random.default_rng(8)
    sizes = np.sort(rng.integers(1, 12, 20))
    x = np.where(np.arange(11) < sizes[:, None], 1, 0)[:, :sizes.max(), None] * rng.normal(size=(20, sizes.max(), 4)) * spread
    rest = (rng.normal(size=(4, 4)) * spread, rng.normal(size=4) * spread, rng.normal(size=4) * spread)
    for got, want in zip(chains.forward_backward(x, sizes, *rest), chains._log_forward_backward(x, sizes, *rest)):
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9)
