"""Hidden Markov word classes against enumeration, and the content rule on texts made of two kinds of words."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from readgauge.functions import text as tx
from readgauge.operators.wordclasses import Markov, WordClasses, function_classes

ARTICLES = ["the", "a", "this"]
VERBS = ["is", "has"]
NOUNS = [f"noun{i}" for i in range(60)]
ADJECTIVES = [f"adj{i}" for i in range(60)]


def sentence(rng):
    return f"{rng.choice(ARTICLES)} {rng.choice(NOUNS)} {rng.choice(VERBS)} {rng.choice(ADJECTIVES)}"


@pytest.fixture(scope="module")
def model(spark, texts):
    return WordClasses.fit(spark.createDataFrame(texts, "i int, lang string, text string").repartition(3), "text", "lang", classes=4, rounds=40)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(2)
    rows = [(i, "en", ". ".join(sentence(rng) for _ in range(8)) + ".") for i in range(120)]
    return rows + [(900, None, "uno dos. uno dos. uno tres dos."), (901, "en", None), (902, "xx", "once only"), (903, "en", "")]


def test_counts_by_enumeration():
    model = Markov.random(3, 4, 7)
    sentences = [[0, 2, 1], [3], [1, 1, 0, 2]]
    words, begins = np.concatenate(sentences), np.array([0, 3, 4, 8])
    total, first, moves, emits = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))
    for s in sentences:
        paths = {}
        for path in product(range(3), repeat=len(s)):
            p = model.first[path[0]] * np.prod([model.emits[k, w] for k, w in zip(path, s)])
            paths[path] = p * np.prod([model.moves[a, b] for a, b in zip(path, path[1:])])
        whole = sum(paths.values())
        total += np.log(whole)
        for path, p in paths.items():
            first[path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / whole
            for k, w in zip(path, s):
                emits[k, w] += p / whole
    got, counts = model.expected(words, begins)
    assert got == pytest.approx(total)
    assert np.allclose(counts.first, first) and np.allclose(counts.moves, moves) and np.allclose(counts.emits, emits)


def test_likelihood_never_falls(model):
    steps = np.diff(model.likelihoods)
    assert len(steps) == 39 and (steps > -1e-6 * abs(model.likelihoods[0])).all() and steps[0] > 0


def test_function_words_are_found(model):
    assert set(model.function_words("en")) == {*ARTICLES, *VERBS}
    classes = dict(zip([w for w, _ in model.words["en"]], model.classes["en"].tolist()))
    assert len({classes[w] for w in ARTICLES}) == 1 and len({classes[w] for w in VERBS}) == 1


def test_content_words_of_rows(spark, model):
    rows = [("en", "The noun3 has adj2 and never"), ("xx", "once the"), (None, "uno dos nada"), ("en", ""), ("en", None)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = [r["c"] for r in df.select(model.content(tx.lower_words(F.col("text")), F.col("lang")).alias("c")).collect()]
    assert got[0] == ["noun3", "adj2", "and", "never"] and got[1] == ["once", "the"] and got[3] == [] and got[4] is None
    assert "nada" in got[2]


def test_table_covers_the_vocabulary(spark, model):
    rows = model.table(spark).collect()
    assert {r["w"] for r in rows if r["lang"] == "en"} == {*ARTICLES, *VERBS, *NOUNS, *ADJECTIVES}
    assert {r["lang"] for r in rows} == {"en", None} and all(r["n"] >= 3 for r in rows)


def test_rule_takes_narrow_classes_up_to_the_share():
    emits = np.array([[50.0, 0, 0, 0], [0, 10, 10, 10], [0, 0, 10, 10]])
    counts = Markov(np.ones(3), np.ones((3, 3)), emits)
    assert function_classes(counts, 0.5) == {0} and function_classes(counts, 0.75) == {0, 2} and function_classes(counts, 0.1) == set()


def test_an_empty_corpus(spark):
    found = WordClasses.fit(spark.createDataFrame([("en", None)], "lang string, text string"), "text", "lang")
    assert found.words == {} and found.table(spark).count() == 0
