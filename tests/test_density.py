"""Curves and histograms of many features against the exact sums."""

import numpy as np
import pytest

from readgauge.operators import profile


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    a = np.round(rng.gamma(2, 3, 400), 2)
    return [(str(g), float(x), None if i % 9 == 0 else float(rng.normal()), 4.0 if g == "p" else None)
            for i, (g, x) in enumerate(zip(rng.choice(["p", "q"], 400), a))] + [(None, 1.0, 2.0, None), ("lone", None, None, None)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g string, a double, b double, c double").repartition(3).cache()


def values(rows, g, j):
    return np.array([r[j] for r in rows if r[0] == g and r[j] is not None])


@pytest.mark.parametrize("cells", [16, 1024])
def test_curves_are_within_the_bound(df, rows, cells):
    got = {}
    for r in profile.density_curves(df, ["a", "b", "c"], "g", 30, cells).collect():
        got.setdefault((r["g"], r["feature"]), {})[r["point"]] = r["x"], r["density"]
    assert set(got) == {(g, f) for g in "pq" for f in "ab"}  # the others have one value or none
    for (g, f), curve in got.items():
        v = values(rows, g, 1 + "abc".index(f))
        h = len(v) ** -0.2 * v.std(ddof=1)
        step = (v.max() - v.min()) / cells
        bound = step ** 2 / (8 * h ** 3 * np.sqrt(2 * np.pi))
        assert sorted(curve) == list(range(30))
        for point, (x, density) in curve.items():
            assert x == pytest.approx(v.min() + point * (v.max() - v.min()) / 29)
            exact = np.exp(-(((v - x) / h) ** 2) / 2).mean() / (h * np.sqrt(2 * np.pi))
            assert abs(density - exact) <= bound + 1e-12


def test_histograms_of_all_features(df, rows):
    found = profile.histograms(df, ["a", "b", "c"], "g", 8).collect()
    keys = {r[0] for r in rows if any(x is not None for x in r[1:])} - {None}
    for j, f in enumerate("abc", 1):
        every = np.array([r[j] for r in rows if r[j] is not None])
        low, high = every.min(), every.max()
        if low == high:
            low, high = low - 0.5, high + 0.5
        for g in keys:
            v = values(rows, g, j)
            want = np.histogram(v, 8, (low, high))[0]
            got = {r["bin"]: r for r in found if r["g"] == g and r["feature"] == f}
            assert [got[i]["n"] for i in range(8)] == want.tolist()
            total = sum(r["density"] for r in got.values()) * (high - low) / 8
            assert total == pytest.approx(1 if len(v) else 0)


def test_no_rows(df):
    assert profile.density_curves(df.limit(0), ["a"], "g").count() == 0 and profile.histograms(df.limit(0), ["a"], "g").count() == 0
