import math
import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readgauge.functions import lexicon, measures as ms, text as tx

EDGES = ["", "Word", "No terminator", "One. Two! Three?", "A a a. A a a.", "12 34.", " \n\t ", "Été à la plage. Größe 3?",
         "e.g. this is 3.14 long... Yes", "Tree agree table the rhythm made be. Eel", "日本語。 テスト", " lead. trail. "]


def evaluate(spark, texts, **columns):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select(
        "i", *[c.alias(n) for n, c in columns.items()]
    ).orderBy("i").collect()
    return [{n: r[n] for n in columns} for r in rows]


def naive_sentences(text):
    marked = re.sub(r"([.!?]+)[ \n\t\r]+", "\\1\x01", text)
    return [s for s in (p.strip(" \n\t\r") for p in marked.split("\x01")) if s]


def naive_words(text):
    import regex
    return regex.findall(r"[\p{L}\p{N}]+", text)


def naive_syllables(text):
    total = 0
    for word in naive_words(text):
        runs = len(re.findall("[aeiouyAEIOUY]+", word))
        if runs > 1 and re.search("[^aeiouyAEIOUYlL][eE]$", word):
            runs -= 1
        total += max(runs, 1)
    return total


def naive_bow(text):
    bags = [Counter(naive_words(s.lower())) for s in naive_sentences(text)]
    if len(bags) < 2:
        return 1.0
    sims = []
    for a, b in zip(bags, bags[1:]):
        norms = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
        sims.append(sum(a[k] * b[k] for k in a) / norms if norms else 0.0)
    return sum(sims) / len(sims)


def check(spark, texts):
    t = F.col("text")
    found = evaluate(
        spark, texts, s=tx.sentences(t), n=tx.sentence_count(t), w=tx.words(t), k=tx.word_count(t),
        y=tx.syllable_count(t), bow=ms.adjacent_bow_cosine(tx.lower_sentences(t)),
    )
    for text, row in zip(texts, found):
        assert row["s"] == naive_sentences(text), text
        assert row["n"] == len(row["s"]), text
        assert row["w"] == naive_words(text) and row["k"] == len(row["w"]), text
        assert row["y"] == naive_syllables(text), text
        assert row["bow"] == pytest.approx(naive_bow(text)), text


def test_edge_texts(spark):
    check(spark, EDGES)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aeby lL.!? \nE3é", max_size=60), min_size=20, max_size=60))
def test_random_texts(spark, texts):
    check(spark, texts)


def test_long_text_without_terminator(spark):
    words = [f"w{i % 977}" for i in range(20_000)]
    check(spark, [" ".join(words), " ".join(words[:10_000]) + ". " + " ".join(words[10_000:])])


def test_readability_formulas(spark):
    row = evaluate(
        spark, ["The cat sat. The dog ran home."], g=ms.fkgl(F.lit(7), F.lit(2), F.lit(8)), e=ms.fre(F.lit(7), F.lit(2), F.lit(8)),
        zero=ms.fre(F.lit(0), F.lit(0), F.lit(0)),
    )[0]
    assert row["g"] == pytest.approx(0.39 * 3.5 + 11.8 * 8 / 7 - 15.59)
    assert row["e"] == pytest.approx(206.835 - 1.015 * 3.5 - 84.6 * 8 / 7)
    assert row["zero"] == pytest.approx(206.835)


def test_connectives_as_parts_and_as_words(spark):
    texts = ["It was big. Also red. No hit", "", "Because it rained."]
    sents = tx.lower_sentences(F.col("text"))
    rows = evaluate(spark, texts, part=ms.connective_coverage(sents), word=ms.connective_coverage(sents, "word"))
    assert [r["part"] for r in rows] == pytest.approx([2 / 3, 0, 1])
    assert [r["word"] for r in rows] == pytest.approx([1 / 3, 0, 1])
    with pytest.raises(ValueError):
        ms.connective_coverage(sents, "other")


def test_patterns_keep_their_words():
    pattern = re.compile(tx.any_word_of(lexicon.CLAUSE_MARKERS).replace(r"\p{L}\p{N}", "a-z0-9"))
    for word in lexicon.CLAUSE_MARKERS:
        assert pattern.fullmatch(word) and not pattern.search("x" + word) and not pattern.search(word + "x")
    parts = tx.shortest_parts(lexicon.CONNECTIVES)
    assert len(set(lexicon.CONNECTIVES)) == 55
    assert all(any(p in c for p in parts) for c in lexicon.CONNECTIVES)


def test_tokens_with_punctuation_and_truncation(spark):
    t = F.col("text")
    row = evaluate(
        spark, ["Don't stop, now!"], words=tx.words(t), both=tx.words(t, "words+punct"), n=tx.word_count(t, "words+punct"),
        first=tx.truncated(tx.words(t), 2),
    )[0]
    assert row["words"] == ["Don", "t", "stop", "now"]
    assert row["both"] == ["Don", "'", "t", "stop", ",", "now", "!"] and row["n"] == 7
    assert row["first"] == ["Don", "t"]


def test_content_words_and_cue_roles(spark):
    t = F.col("text")
    row = evaluate(
        spark, ["We used with cells. Therefore we conclude. It rains."],
        content=ms.content_words(tx.lower_words(t)), roles=F.transform(tx.lower_sentences(t), lambda s: ms.cue_role(s)),
    )[0]
    assert row["content"] == ["used", "cells", "therefore", "conclude", "rains"]
    assert row["roles"] == ["methods", "conclusions", "background"]


def test_cosine(spark):
    row = spark.range(1).select(
        ms.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("a"),
        ms.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("zero"),
    ).first()
    assert row["a"] == pytest.approx(math.sqrt(0.5)) and row["zero"] == 0


def test_whole_words_are_dismissed_by_their_first_letters():
    assert tx.any_word_of(["for", "to"]).startswith("(?=[ft])")
    assert not tx.any_word_of(["for", ""]).startswith("(?=") and not tx.any_word_of(["[x"]).startswith("(?=")


def test_neighbours_are_compared_as_sets_of_words(spark):
    rng = random.Random(3)
    texts = [["".join(rng.choices("abcdefgh", k=rng.randint(1, 2))) for _ in range(rng.randint(0, 30))] for _ in range(80)]
    texts = [[texts[i], texts[i + 1], texts[i]] for i in range(len(texts) - 1)]
    rows = [(i, [" ".join(s) for s in t]) for i, t in enumerate(texts)] + [(900, []), (901, ["a a b"]), (902, None), (903, ["", "a a"])]
    df = spark.createDataFrame(rows, "i int, s array<string>").select("i", ms.adjacent_bow_cosine(F.col("s")).alias("v"))
    assert "array_intersect" in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r["i"]: r["v"] for r in df.collect()}

    def cosine(x, y):
        x, y = Counter(x), Counter(y)
        norms = math.sqrt(sum(n * n for n in x.values())) * math.sqrt(sum(n * n for n in y.values()))
        return sum(n * y[w] for w, n in x.items()) / norms if norms else 0.0

    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(sum(map(cosine, t, t[1:])) / 2, abs=1e-12)
    assert [got[i] for i in (900, 901, 902, 903)] == [1.0, 1.0, 1.0, 0.0]
