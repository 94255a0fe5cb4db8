"""Order-dependent and corpus-wide operators against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readgauge.functions import lexicon
from readgauge.operators import coherence, stats
from readgauge.operators.language import CorpusModel


@pytest.mark.parametrize("stretch", [1, 3, 10, 1000])
def test_neighbours_across_stretches(spark, stretch):
    rng = np.random.default_rng(0)
    data = {"hot": sorted(rng.choice(200, 80, replace=False).tolist()), "one": [5], "two": [0, 199]}
    df = spark.createDataFrame([(s, int(p), f"{s}{p}") for s, ps in data.items() for p in ps], "s string, p int, v string")
    got = {(r["s"], r["p"]): r["nxt"] for r in coherence.with_next(df.repartition(5), "s", "p", "v", "nxt", stretch).collect()}
    assert got == {(s, p): (f"{s}{ps[i + 1]}" if i + 1 < len(ps) else None) for s, ps in data.items() for i, p in enumerate(ps)}


def test_adjacent_cosine(spark):
    x = np.random.default_rng(2).normal(size=(30, 4))
    x[7] = 0
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)] + [("b", 0, [1.0, 0.0, 0.0, 0.0])], "s string, p int, v array<double>")
    norms = np.linalg.norm(x, axis=1)
    dots, scale = (x[:-1] * x[1:]).sum(axis=1), norms[:-1] * norms[1:]
    expected = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0).mean()
    got = {r["s"]: r["adjacent_cosine"] for r in coherence.adjacent_cosine(df, "s", "p", "v", stretch=4).collect()}
    assert got == {"a": pytest.approx(expected), "b": 1.0}


TRAIN = ["the cell grows and the cell divides", "the tissue grows", "", "cell", "tissue and cell and tissue again"]
SCORED = [*TRAIN, "unknown words only here", "the cell unknown the", "the"]


def naive_scores(train, texts):
    words = [re.findall(r"\w+", t.lower()) for t in train]
    n = Counter(w for ws in words for w in ws)
    pairs = Counter(p for ws in words for p in zip(ws, ws[1:]))
    before = Counter(w for ws in words for w in ws[:-1])
    total, v = sum(n.values()), len(n)
    out = []
    for text in texts:
        ws = re.findall(r"\w+", text.lower())
        known = [w for w in ws if n[w] and len(w) >= 4 and w not in lexicon.STOP_WORDS]
        cwe = sum(-math.log(n[w] / total) for w in known) / len(known) if known else None
        both = list(zip(ws, ws[1:]))
        nll = [-math.log((pairs[p] + 1) / (before[p[0]] + v)) for p in both]
        out.append((cwe, math.exp(sum(nll) / len(nll)) if nll else None))
    return out


def test_language_scores(spark):
    train = spark.createDataFrame([(t,) for t in TRAIN], "text string")
    model = CorpusModel.fit(train, "text")
    df = spark.createDataFrame(list(enumerate(SCORED)), "i int, text string")
    got = {r["i"]: (r["cwe"], r["ppl"]) for r in model.score(df, "text", ["i"]).collect()}
    for i, want in enumerate(naive_scores(TRAIN, SCORED)):
        assert got[i] == pytest.approx(want), SCORED[i]
        assert got[i][1] is None or got[i][1] >= 1
    own = spark.createDataFrame(list(enumerate(TRAIN)), "i int, text string")
    known = {r["i"]: (r["cwe"], r["ppl"]) for r in model.score(own, "text", ["i"], known=True).collect()}
    assert all(known[i] == pytest.approx(got[i]) for i in range(len(TRAIN)))


def test_no_size_decides_the_plan(spark):
    """Tables are joined by shuffles; broadcasts come from adaptive execution, from sizes it has seen."""
    df = spark.createDataFrame(list(enumerate(SCORED)), "i int, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = CorpusModel.fit(df, "text").score(df, "text", ["i"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 4 and "BroadcastHashJoin" not in plan and "Cartesian" not in plan


def test_word_model_alone(spark):
    df = spark.createDataFrame(list(enumerate(SCORED)), "i int, text string")
    model = CorpusModel.fit(df, "text", pairs=False)
    got = {r["i"]: r["cwe"] for r in model.score(df, "text", ["i"], ppl=False).collect()}
    assert [got[i] for i in range(len(SCORED))] == pytest.approx([c for c, _ in naive_scores(SCORED, SCORED)])


def test_repeated_ids_keep_their_values(spark):
    from readgauge.plans.feature_table import feature_table
    data = [("a", "One cell. Two cells grow.", "Short."), ("a", "Other text here.", ""), ("a", "One cell. Two cells grow.", "Short.")]
    df = spark.createDataFrame(data, "doc_id string, abstract string, summary string")
    got = feature_table(df).collect()
    assert len(got) == 3 and len({r["abstract_ppl"] for r in got}) == 2
    assert sorted(r["abstract_length"] for r in got) == [3, 5, 5]


def test_given_roles_replace_cue_roles(spark):
    from readgauge.plans.feature_table import feature_table
    pairs = spark.createDataFrame([("a", "Text here.", "Short.")], "doc_id string, abstract string, summary string")
    names = [f"{s}_{r}_ratio" for s in ("abstract", "summary") for r in lexicon.ROLES]
    given = spark.createDataFrame([("a", *[0.1 * i for i in range(10)])], "doc_id string, " + ", ".join(f"{n} double" for n in names))
    row = feature_table(pairs, roles=given).first()
    assert [row[n] for n in names] == pytest.approx([0.1 * i for i in range(10)])


def naive_hash(key, seed=42):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:8], 16)


def test_hash_split(spark):
    df = spark.range(500).select(F.col("id").alias("k"), stats.hash_number(F.col("id")).alias("h"), stats.in_test(F.col("id"), 0.3).alias("t"))
    got = df.collect()
    assert all(r["h"] == naive_hash(r["k"]) for r in got)
    assert 0.2 < sum(r["t"] for r in got) / 500 < 0.4
    assert [r["t"] for r in got] == [r["t"] for r in df.collect()]


@pytest.mark.parametrize("bits", [1, 4, 16])
@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.3, 1.0])
def test_exact_stratified_split(spark, bits, fraction):
    data = [(i, "hot" if i % 10 else "rare") for i in range(333)] + [(1000, "single")]
    df = spark.createDataFrame(data, "k int, y string").repartition(6)
    got = {r["k"]: r["is_test"] for r in stats.stratified_test_flag(df, "k", "y", fraction, bucket_bits=bits).collect()}
    assert len(got) == len(data)
    for label in ("hot", "rare", "single"):
        keys = sorted((k for k, y in data if y == label), key=naive_hash)
        wanted = math.floor(fraction * len(keys) + 0.5)
        assert [k for k in keys if got[k]] == keys[:wanted]


def test_standardizer_and_imputer(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, 4.0), (5.0, 5.0, 6.0)], "a double, b double, c double")
    scaled = stats.Standardizer.fit(df, ["a", "b"]).transform(df).collect()
    assert [r["a"] for r in scaled] == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)])
    assert [r["b"] for r in scaled] == [0, 0, 0]
    assert [r["c"] for r in stats.impute_mean(df, ["c"]).collect()] == pytest.approx([5, 4, 6])


def test_components_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) @ rng.normal(size=(3, 4)) + rng.normal(size=(60, 4)) * 0.1
    gaps = [(i, *[None if (i + j) % 17 == 0 else float(v) for j, v in enumerate(row)]) for i, row in enumerate(x)]
    df = spark.createDataFrame(gaps, "i int, a double, b double, c double, d double")
    found = stats.PrincipalComponents.fit(df, list("abcd"))
    filled = np.array([[np.nan if v is None else v for v in g[1:]] for g in gaps])
    filled = np.where(np.isnan(filled), np.nanmean(filled, axis=0), filled)
    z = (filled - filled.mean(axis=0)) / filled.std(axis=0)
    values = np.linalg.eigvalsh(np.cov(z.T))[::-1]
    assert found.ratios == pytest.approx(values / values.sum())
    scores = found.scores(df, "i").toPandas().sort_values("i").drop(columns="i").to_numpy()
    assert np.allclose(scores, z @ np.array(found.loadings).T)
    assert len(stats.PrincipalComponents.fit(df.limit(3), list("abcd")).loadings) == 2


def test_correlation(spark):
    x = np.random.default_rng(4).normal(size=(40, 3))
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    got = {(r["a"], r["b"]): r["corr"] for r in stats.correlation(df, list("abc")).collect()}
    r = np.corrcoef(x.T)
    assert got == {("a", "b"): pytest.approx(r[0, 1]), ("a", "c"): pytest.approx(r[0, 2]), ("b", "c"): pytest.approx(r[1, 2])}
