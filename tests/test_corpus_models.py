"""Kneser-Ney trigrams, learned sentence vectors and learned sentence boundaries against brute force and laws."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readgauge.operators import boundaries, stats, trigrams, vectors
from readgauge.operators.language import CorpusModel
from readgauge.operators.trigrams import KneserNey

SF = "/root/testdata/sf0.001"
TRAIN = ["the cell grows and the cell divides and the cell dies", "the tissue grows", "", None, "cell", "tissue and cell and tissue again",
         "the cell grows", "and the cell grows and the end", "a b c d e f g", "a b c a b c a b d"]
SCORED = [*TRAIN, "unknown words only here", "the cell unknown the", "the", "grows the"]


class Model:
    def __init__(self, texts):
        self.k3 = Counter()
        for t in texts:
            w = ["<1>", "<2>", *re.findall(r"\w+", (t or "").lower())]
            self.k3.update(zip(w, w[1:], w[2:]))
        self.k2 = Counter((v, w) for _, v, w in self.k3)
        self.k1 = Counter(w for _, w in self.k2)
        self.d = [trigrams.discounts(*[sum(n == i for n in k.values()) for i in (1, 2, 3, 4)]) for k in (self.k1, self.k2, self.k3)]

    def level(self, counts, d, item, lower):
        total = sum(counts.values())
        if not total:
            return lower
        given = sum(d[min(n, 3) - 1] for n in counts.values()) / total
        n = counts.get(item, 0)
        return (n - d[min(n, 3) - 1] if n else 0) / total + given * lower

    def p(self, u, v, w):
        p1 = self.level(self.k1, self.d[0], w, 1 / (len(self.k1) + 1))
        p2 = self.level({b: n for (a, b), n in self.k2.items() if a == v}, self.d[1], w, p1)
        return self.level({c: n for (a, b, c), n in self.k3.items() if (a, b) == (u, v)}, self.d[2], w, p2)

    def ppl(self, text):
        w = ["<1>", "<2>", *re.findall(r"\w+", (text or "").lower())]
        nll = [-math.log(self.p(*x)) for x in zip(w, w[1:], w[2:])]
        return math.exp(sum(nll) / len(nll)) if nll else None


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)


def test_perplexity_by_hand(spark):
    found = KneserNey.fit(table(spark, TRAIN), "text")
    by_hand = Model(TRAIN)
    got = {r["i"]: r["ppl"] for r in found.score(table(spark, SCORED), "text", ["i"]).collect()}
    assert [got[i] for i in range(len(SCORED))] == [pytest.approx(by_hand.ppl(t)) for t in SCORED]
    own = {r["i"]: r["ppl"] for r in found.score(table(spark, TRAIN), "text", ["i"], known=True).collect()}
    assert [own[i] for i in range(len(TRAIN))] == [pytest.approx(by_hand.ppl(t)) for t in TRAIN]


def test_triples_stay_in_the_buckets_of_their_middle_word(spark):
    df, by_hand = table(spark, TRAIN), Model(TRAIN)
    found = KneserNey.fit(df, "text", keys=["i"])
    scored = found.score(df, "text", ["i"], known=True)
    own = {r["i"]: r["ppl"] for r in scored.collect()}
    assert [own[i] for i in range(len(TRAIN))] == [pytest.approx(by_hand.ppl(t)) for t in TRAIN]
    plan = scored._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1  # the sums of a text
    fresh = KneserNey.load(spark.newSession(), found.path).score(table(spark, SCORED), "text", ["i"])
    got = {r["i"]: r["ppl"] for r in fresh.collect()}
    assert [got[i] for i in range(len(SCORED))] == [pytest.approx(by_hand.ppl(t)) for t in SCORED]


def test_known_texts_are_scored_without_sorting_them(spark):
    """Counts lie beside the occurrences, so only small tables are joined; null and repeated keys are those of one text."""
    texts = [(1, TRAIN[0]), (1, TRAIN[1]), (None, TRAIN[-1]), (2, None), (3, TRAIN[0]), (None, TRAIN[0])]
    df, by_hand = spark.createDataFrame(texts, "i int, text string").repartition(3), Model([t for _, t in texts if t])
    found = KneserNey.fit(df, "text", keys=["i"])
    scored = found.score(df, "text", ["i"], known=True)
    plan = scored._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan and "Sort [" not in plan
    got = {r["i"]: r["ppl"] for r in scored.collect()}
    for key in (1, None, 3):
        nll = [(math.log(by_hand.ppl(t)), len(re.findall(r"\w+", t))) for k, t in texts if k == key and t]
        assert math.log(got[key]) == pytest.approx(sum(x * n for x, n in nll) / sum(n for _, n in nll))
    assert got[2] is None and len(got) == 4
    plain = KneserNey.fit(df, "text")
    assert (found.n_words, found.n_pairs, found.triple_discounts, found.pair_discounts) == (
        plain.n_words, plain.n_pairs, plain.triple_discounts, plain.pair_discounts)


@pytest.mark.parametrize("context", [("the", "cell"), ("<1>", "<2>"), ("cell", "cell"), ("new", "words"), ("b", "c")])
def test_probabilities_of_a_context_add_up(context):
    by_hand = Model(TRAIN)
    assert sum(by_hand.p(*context, w) for w in [*by_hand.k1, "<unknown>"]) == pytest.approx(1)


def test_discounts():
    assert trigrams.discounts(0, 0, 0, 0) == (0.5, 0.5, 0.5)
    d = trigrams.discounts(1000, 400, 200, 120)
    assert 0 < d[0] < 1 and d[0] < d[1] < 2 and d[1] < d[2] < 3
    assert trigrams.discounts(5, 0, 0, 9) == (1.0, 1.0, 1.0)
    assert all(x >= trigrams.LEAST_DISCOUNT for x in trigrams.discounts(1, 900, 900, 9000))


def test_an_empty_corpus_knows_nothing(spark):
    model = KneserNey.fit(table(spark, [None, ""]), "text")
    got = {r["i"]: r["ppl"] for r in model.score(table(spark, ["a b", ""]), "text", ["i"]).collect()}
    assert got == {0: pytest.approx(1), 1: None}


def test_trigrams_predict_better_than_add_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held = stats.in_test(F.col("doc_id"), 0.2)
    mean = lambda df: df.agg(F.avg(F.log("ppl"))).first()[0]
    ours = KneserNey.fit(docs.filter(~held), "text").score(docs.filter(held), "text", ["doc_id"])
    add_one = CorpusModel.fit(docs.filter(~held), "text").score(docs.filter(held), "text", ["doc_id"], cwe=False)
    assert mean(ours) < mean(add_one)


def test_no_size_decides_the_plan(spark):
    df = table(spark, SCORED)
    plan = KneserNey.fit(table(spark, TRAIN), "text").score(df, "text", ["i"])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_occurrences_move_as_keys_and_one_hash(spark):
    df = table(spark, TRAIN)
    scored = CorpusModel.fit(df, "text").score(df, "text", ["i"], known=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scored._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert sorted(set(moved)) == ["h", "i"]  # no word moves to be looked up
    held_out = CorpusModel.fit(df, "text").score(table(spark, SCORED), "text", ["i"])
    words = [re.findall(r"\w+", (t or "").lower()) for t in TRAIN]
    single, followed = Counter(w for x in words for w in x), Counter(v for x in words for v in x[:-1])
    pairs = Counter(p for x in words for p in zip(x, x[1:]))
    for texts, frame in ((TRAIN, scored), (SCORED, held_out)):
        got = {r["i"]: r["ppl"] for r in frame.collect()}
        for i, text in enumerate(texts):
            x = re.findall(r"\w+", (text or "").lower())
            logs = [math.log((followed[v] + len(single)) / (pairs[v, w] + 1)) for v, w in zip(x, x[1:])]
            assert got[i] == (pytest.approx(math.exp(np.mean(logs))) if logs else None)


# --- sentence vectors

TOPICS = (["cell", "membrane", "protein", "tissue", "nucleus"], ["market", "price", "trade", "money", "bank"], ["river", "lake", "water", "fish", "boat"])


@pytest.fixture(scope="module")
def topical():
    rng = np.random.default_rng(4)
    say = lambda words: " ".join(["the", *rng.choice(words, 6), "and", *rng.choice(words, 3)]).capitalize() + "."
    kept = [" ".join(say(TOPICS[i % 3]) for _ in range(6)) for i in range(90)]
    mixed = [" ".join(say(TOPICS[j % 3]) for j in range(6)) for _ in range(30)]
    return kept, mixed


@pytest.fixture(scope="module")
def sentence_model(spark, topical):
    return vectors.SentenceModel.fit(table(spark, topical[0] + topical[1]), "text", width=6)


def test_neighbours_on_one_topic_are_alike(spark, topical, sentence_model):
    kept, mixed = topical
    texts = kept + mixed + ["Cell tissue protein. Cell tissue protein.", "One sentence about cell.", "", None, "Xx yy. Zz qq.", "Cell. Unknown."]
    got = {r["i"]: r["s"] for r in sentence_model.neighbour_similarity(table(spark, texts), "text", "i", out="s").collect()}
    same = [got[i] for i in range(len(kept))]
    other = [got[len(kept) + i] for i in range(len(mixed))]
    assert np.mean(same) > 0.9 and np.mean(other) < 0.2
    rest = [got[i] for i in range(len(kept) + len(mixed), len(texts))]
    assert rest == [pytest.approx(1), 1.0, 1.0, 1.0, 0.0, 0.0]


def test_similarity_by_hand(spark, topical, sentence_model):
    texts = topical[1][:7] + ["Cell. The money bank. River fish. Nothing here"]
    got = {r["i"]: r["similarity"] for r in sentence_model.neighbour_similarity(table(spark, texts), "text", "i").collect()}
    number = {r["h"]: r["w"] for r in spark.createDataFrame([(w,) for t in TOPICS for w in [*t, "the", "and"]], "w string")
              .select("w", F.xxhash64("w").alias("h")).distinct().collect()}
    known = {number[int(h)]: sentence_model.vectors[i] for h, i in zip(sentence_model.lexicon.hashes, sentence_model.lexicon.number)}
    for i, text in enumerate(texts):
        v = []
        for s in re.split(r"(?<=[.!?])\s+", text.lower()):
            own = [known[w] for w in re.findall(r"\w+", s) if w in known]
            v.append(np.mean(own, axis=0) if own else np.zeros(6))
            v[-1] = v[-1] - (v[-1] @ sentence_model.common) * sentence_model.common
        cosine = [a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if np.linalg.norm(a) * np.linalg.norm(b) > 1e-18 else 0 for a, b in zip(v, v[1:])]
        assert got[i] == pytest.approx(np.mean(cosine))


def brute_pairs(texts, known, window=4):
    n = Counter()
    for t in texts:
        for s in re.split(r"(?<=[.!?])\s+", (t or "").lower()):
            w = re.findall(r"\w+", s)
            for i, j in ((i, j) for i in range(len(w)) for j in range(i + 1, min(len(w), i + window + 1))):
                if w[i] in known and w[j] in known:
                    n[w[i], w[j]] += 1
                    n[w[j], w[i]] += 1
    return n


def test_word_pairs_by_hand(spark, topical):
    texts = topical[0][:20] + [None, "", "cell cell cell"]
    words = Counter(w for t in texts for w in re.findall(r"\w+", (t or "").lower()))
    known = sorted((w for w in words if words[w] >= 5), key=lambda w: (-words[w], w))[:12]
    n = brute_pairs(texts, set(known))
    margin = Counter()
    for (a, _), c in n.items():
        margin[a] += c
    total = sum(margin.values())
    want = {k: (c, pytest.approx(math.log(c * total / (margin[k[0]] * margin[k[1]])))) for k, c in n.items() if c * total > margin[k[0]] * margin[k[1]]}
    got = vectors.word_pairs(table(spark, texts), "text", size=12).collect()
    assert {(r["w"], r["near"]): (r["n"], r["ppmi"]) for r in got} == want


def test_associated_pairs_do_not_move(spark, topical):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = vectors.word_pairs(table(spark, topical[0][:20]), "text", size=12)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 4 and "SortMergeJoin" not in plan and "MapInArrow" not in plan


def test_counts_are_whole_when_memory_fills(spark, topical):
    df, n = table(spark, topical[0]), 60
    lexicon = vectors.Lexicon(vectors.vocabulary(df, "text").select(F.xxhash64("w").alias("h")).toPandas()["h"].to_numpy(np.int64))
    rows = lambda most: sorted(map(tuple, vectors.cooccurrences(df, "text", lexicon, held_most=most).collect()))
    assert rows(3) == rows(n) == rows(10 ** 6)


def test_factors_are_the_leading_ones(spark):
    rng = np.random.default_rng(1)
    m = rng.random((30, 6)) @ rng.random((6, 30))
    m = (m + m.T) / 2 * (rng.random((30, 30)) < 0.5)
    m = (m + m.T) / 2
    df = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(30) for j in range(30) if m[i, j]], "a int, b int, ppmi double").repartition(4)
    f = vectors.factors(df, 30, width=12, passes=30)
    values, full = np.linalg.eigh(m)
    order = np.argsort(-np.abs(values))[:3]
    for k, j in enumerate(order):
        assert abs(abs(f[:, k] @ full[:, j]) - np.sqrt(abs(values[j]))) < 1e-4
    assert np.allclose(f, vectors.factors(df.repartition(2), 30, width=12, passes=30), atol=1e-6)


def test_vectors_of_an_empty_corpus(spark):
    model = vectors.SentenceModel.fit(table(spark, [None, ""]), "text")
    got = [r["similarity"] for r in model.neighbour_similarity(table(spark, ["a b. c d.", "", None]), "text", "i").orderBy("i").collect()]
    assert got == [0.0, 1.0, 1.0]


# --- sentence boundaries

NAMES = ["Miller", "Kovac", "Meyer", "Smith", "Jansen", "Weber"]


@pytest.fixture(scope="module")
def learned(spark):
    rng = np.random.default_rng(6)
    texts = []
    for i in range(300):
        name, number = NAMES[i % 6], rng.integers(1, 30)
        texts.append(
            f"The cell of Dr. {name} grows in water. It was found by J. {name} on the {number}. Mai in the morning. "
            f"The price, e.g. of fish, rose to {number}. The bank of the river is full. It is late. "
            "The full bank is near water and late in the morning at home. The water near home is full of late fish in the morning sun. "
            "It is full here. The home of late rain grows near water on a full morning walk. The sun is red.")
    return boundaries.Boundaries.fit(table(spark, texts), "text")


@pytest.mark.parametrize("text,want", [
    ("He met Dr. Miller today. The cell grows.", ["He met Dr. Miller today.", "The cell grows."]),
    ("It was J. Weber. It is late.", ["It was J. Weber.", "It is late."]),
    ("On the 3. Mai it rained. It is late!", ["On the 3. Mai it rained.", "It is late!"]),
    ("Animals, e.g. fish, swim.  The end", ["Animals, e.g. fish, swim.", "The end"]),
    ("He had 3. The bank is full.", ["He had 3.", "The bank is full."]),
    ("Really?! Yes. ok. no", ["Really?!", "Yes.", "ok.", "no"]),
    ("Wait... Dr. \n Kovac", ["Wait...", "Dr. Kovac"]), ("", []), (None, None), (" \n", []), ("Vitamin C. the", ["Vitamin C. the"]), ("\x01 Aha. Box\x01", ["Aha.", "Box"]),
])
def test_learned_split(spark, learned, text, want):
    got = spark.createDataFrame([(text,)], "text string").select(learned.split(F.col("text")).alias("s")).first()["s"]
    assert got == want


def test_learned_lists(learned):
    assert {"dr", "e.g"} <= set(learned.abbreviations) and "grows" not in learned.abbreviations
    assert ("#", "mai") in learned.collocations and "the" in learned.starters


def test_scores_by_hand(spark):
    rows = [("dr", 40, 0), ("cell", 3, 200), ("e.g", 12, 0), ("a", 9, 900), ("#", 50, 10), ("x", 0, 5)]
    counted = spark.createDataFrame(rows, "type string, n_stop long, n_plain long")
    total, stops = sum(n + m for _, n, m in rows), sum(n for _, n, _ in rows)
    p = stops / total
    want = {}
    for t, n, m in rows:
        if n and re.search("[a-z]", t):
            k = len(t) - t.count(".")
            llr = 2 * (n * math.log(0.99) + m * math.log(0.01) - n * math.log(p) - m * math.log(1 - p))
            want[t] = llr * math.exp(-k) * (t.count(".") + 1) * k ** -float(m)
    assert {r["type"]: r["score"] for r in boundaries.abbreviation_scores(counted).collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_likelihood_ratio_is_zero_at_chance(spark):
    df = spark.createDataFrame([(10, 100, 100, 1000), (50, 100, 100, 1000), (1, 100, 500, 1000), (5, 5, 5, 10)], "k long, a long, b long, n long")
    got = [r[0] for r in df.select(boundaries.likelihood_ratio(*map(F.col, "kabn"))).collect()]
    assert got[0] == 0 and got[1] > 50 and got[2] == 0 and got[3] > 10


def test_boundaries_of_an_empty_corpus(spark):
    model = boundaries.Boundaries.fit(table(spark, [None, ""]), "text")
    assert model == boundaries.Boundaries((), (), ())
    assert [r["sentence"] for r in boundaries.split_rows(table(spark, ["Aa bb. Cc dd."]), "text", "i", model=model).collect()] == ["Aa bb.", "Cc dd."]


def test_types_are_found_once_a_token(spark):
    """Counted by hand over occurrences; and the statistics hold a row per distinct token, however often it stands."""
    texts = ["Dr. Foo ran. (Dr. Foo)! 3. Mai... a. B c.  Dd   ee?\u0085 Ff", "x. Dr. Foo", None, "", "Dr."] * 3
    df, counts, ends = table(spark, texts), Counter(), Counter()

    def kind(token):
        core = re.sub(r"^[\W_]+|[\W_]+$", "", token.lower())
        return "#" if re.fullmatch(r"\d[\d.,]*", core) else core

    def stop(token):
        return bool(re.search(r"[^\W_]\.[\u0085  ]?$", token))

    for text in texts:
        tokens = [t for t in re.split("[ \n\t\r]+", text or "") if t]
        counts.update((kind(t), stop(t)) for t in tokens)
        for a, b in zip(tokens, tokens[1:]):
            short = len(kind(a)) == 1 or kind(a) in ("#", "dr")
            if kind(a) and kind(b) not in ("", "#") and (stop(a) if short else re.search("[.!?][\u0085  ]?$", a)):
                ends[kind(a) if short else None, kind(b)] += 1
    rows = boundaries.token_rows(df, "text")
    assert rows.count() == len({t for x in texts for t in re.split("[ \n\t\r]+", x or "") if t})
    got = {r["type"]: (r["n_stop"], r["n_plain"]) for r in boundaries.type_counts(rows).collect()}
    assert got == {t: (counts[t, True], counts[t, False]) for t, _ in counts if t}
    after = boundaries.follow_counts(boundaries.end_rows(df, "text"), ["dr"]).collect()
    assert {(r["previous"], r["type"]): r["n_both"] for r in after} == ends and len(after) == len(ends)


SPLIT = ["He met Dr. Miller today. The cell grows.", "It was J. Weber. It is late.", "On the 3. Mai it rained. It is late!", "He had 3. The bank is full.",
         "Animals, e.g. fish, swim.  The end", "Really?! Yes. ok. no", "Wait... Dr. \n Kovac", "Vitamin C. the", "\x01 Aha. Box\x01", "", None, " \n", "One"]


@pytest.mark.parametrize("listed", [0, 1])
def test_no_entry_is_lost_to_a_long_list(spark, listed):
    """Lists with more entries than literals may have stay whole and split as literals do, repeated rows and empty texts included."""
    learning_texts = [
        f"Dr. {name} met J. {name} on the {i % 29 + 1}. Mai, e.g. at home. The bank is full. It is late. The full bank is near water and late. "
        "The water near home is full of late fish. It is full here. The home of late rain grows near water. The sun is red."
        for i in range(50) for name in NAMES]
    learned = boundaries.Boundaries.fit(table(spark, learning_texts), "text")
    model = boundaries.Boundaries.fit(table(spark, learning_texts), "text", listed=listed)
    assert not model.in_literals
    for got, want in zip((model.abbreviations, model.collocations, model.starters), (learned.abbreviations, learned.collocations, learned.starters)):
        rows = [tuple(r) if len(r) > 1 else r[0] for r in got.collect()] if not isinstance(got, tuple) else got
        assert sorted(rows) == sorted(want) and len(want) > 1
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(SPLIT * 2 + learning_texts[:40])] + [(0, SPLIT[0])], "i int, text string")
    whole, other = (sorted(map(tuple, boundaries.split_rows(texts, "text", "i", model=m).collect())) for m in (learned, model))
    assert whole == other and any(s == "Dr. Kovac" for _, _, s in other)
    with pytest.raises(ValueError):
        model.split(F.col("text"))


def test_long_list_of_abbreviations_counts_what_follows(spark):
    rows = boundaries.end_rows(table(spark, ["Dr. Foo ran. No. Go e.g. fish. a. B 3. c x? Dr. Foo"]), "text")
    short = ["dr", "e.g"]
    listed = spark.createDataFrame([(t,) for t in short], "type string")
    as_rows = lambda a: sorted(map(str, boundaries.follow_counts(rows, a).collect()))
    assert as_rows(listed) == as_rows(short) != as_rows([])


def test_sql_keeps_all_entries():
    from readgauge.plans.oracles import ORACLES
    assert "LIMIT" not in ORACLES["sentence_starters"] + ORACLES["sentence_split_learned"]
