"""Per-text measures that need no other row: pure column expressions.

Functions of ``lowered_sents`` take the sentences of a lower-case text, so that
one array serves all of them and no sentence is lower-cased again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon, text as tx


def ratio(numerator: Column, denominator: Column, empty=0.0) -> Column:
    """``numerator / denominator``, and ``empty`` where the denominator is 0."""
    return F.coalesce(
        F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(empty)
    )


def avg_sentence_length(text: Column, tokens: str = "words") -> Column:
    return ratio(tx.word_count(text, tokens), tx.sentence_count(text))


def fkgl(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """Flesch-Kincaid grade level; an undefined ratio counts as 0."""
    return (
        0.39 * ratio(n_words, n_sentences) + 11.8 * ratio(n_syllables, n_words) - 15.59
    )


def fre(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """Flesch reading ease; an undefined ratio counts as 0."""
    return (
        206.835 - 1.015 * ratio(n_words, n_sentences) - 84.6 * ratio(n_syllables, n_words)
    )


def clause_markers(text: Column, markers=lexicon.CLAUSE_MARKERS) -> Column:
    return F.regexp_count(F.lower(text), F.lit(tx.any_word_of(markers)))


def avg_clauses(text: Column, markers=lexicon.CLAUSE_MARKERS) -> Column:
    """Clause-opening words per sentence."""
    return ratio(clause_markers(text, markers), tx.sentence_count(text))


def connective_coverage(lowered_sents: Column, match: str = "substring",
                        connectives=lexicon.CONNECTIVES) -> Column:
    """Share of sentences with a connective.

    ``match='substring'`` also finds "as" inside "was"; ``'word'`` does not.
    """
    if match == "substring":
        parts = tx.shortest_parts(connectives)
        hits = F.filter(lowered_sents, lambda s: reduce(Column.__or__, [F.contains(s, F.lit(p)) for p in parts]))
    elif match == "word":
        pattern = tx.any_word_of(connectives)
        hits = F.filter(lowered_sents, lambda s: s.rlike(pattern))
    else:
        raise ValueError(f"match must be 'substring' or 'word', not {match!r}")
    return ratio(F.size(hits), F.size(lowered_sents))


def content_words(words: Column, stop_words=lexicon.STOP_WORDS, min_length: int = 4) -> Column:
    """Lower-case words that are long enough and no function words."""
    return F.filter(words, lambda w: is_content_word(w, stop_words, min_length))


def is_content_word(word: Column, stop_words=lexicon.STOP_WORDS, min_length: int = 4) -> Column:
    return (F.length(word) >= min_length) & ~word.isin(*stop_words)


def cue_role(lowered: Column, cues=None, default: str = "background") -> Column:
    """The first role one of whose cue words occurs in the lower-case sentence."""
    role = F.lit(default)
    for label, terms in reversed(list((cues or lexicon.ROLE_CUES).items())):
        pattern = tx.any_word_of(terms)
        role = F.when(lowered.rlike(pattern), F.lit(label)).otherwise(role)
    return role


def role_ratio(roles: Column, label: str) -> Column:
    """Share of one role in an array of per-sentence roles, 0 for no sentence."""
    return ratio(F.size(F.filter(roles, lambda r: r == label)), F.size(roles))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; 0 when either has zero norm."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def adjacent_bow_cosine(lowered_sents: Column) -> Column:
    """Mean bag-of-words cosine of neighbouring sentences, 1.0 below two sentences.

    Of a sentence's words, most occur once; those of two neighbours are compared as
    sets. Only words that occur more often become (word, count), are sorted together
    with the neighbour's, where equal words end up side by side, and folded into the
    dot product. Apart from the sorts the work is linear in the text, and nothing is
    shuffled.
    """
    bags = F.transform(lowered_sents, lambda s: _bag(F.sort_array(tx.words(s))))

    def mean_of_pairs(bags: Column) -> Column:
        n = F.greatest(F.size(bags) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(bags, F.lit(1), n), F.slice(bags, F.lit(2), n), _bag_cosine)
        return ratio(F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v), n, empty=1.0)

    return _bound(bags, mean_of_pairs)


def _bag(sorted_words: Column) -> Column:
    """``struct<once: array<w>, more: array<struct<w, n>>, norm>`` of a sorted array of words."""

    def runs(words: Column) -> Column:
        new = lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), i)
        starts = F.filter(F.transform(words, new), lambda i: i.isNotNull())
        return _bound(starts, lambda at: F.zip_with(
            at, F.slice(F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(words))), F.lit(1), F.size(at)),
            lambda i, end: F.struct(F.get(words, i).alias("w"), (end - i + 1).cast("double").alias("n")),
        ))

    def of(words: Column) -> Column:
        again = F.filter(words, lambda w, i: w == F.get(words, i - 1))  # a word n times is here n - 1 times
        return _bound(_bound(again, runs), lambda more: _bound(F.array_except(words, more["w"]), lambda once: F.struct(
            once.alias("once"), more.alias("more"),
            F.sqrt(F.aggregate(more, F.size(once).cast("double"), lambda acc, e: acc + e["n"] * e["n"])).alias("norm"),
        )))

    return _bound(sorted_words, of)


def _bag_cosine(left: Column, right: Column) -> Column:
    start = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("n"), F.lit(0.0).alias("dot"))

    def step(acc: Column, e: Column) -> Column:
        shared = F.when(acc["w"] == e["w"], acc["n"] * e["n"]).otherwise(F.lit(0.0))
        return F.struct(e["w"].alias("w"), e["n"].alias("n"), (acc["dot"] + shared).alias("dot"))

    def ones(once: Column, more: Column) -> Column:
        return F.transform(F.array_intersect(once, more["w"]), lambda w: F.struct(w.alias("w"), F.lit(1.0).alias("n")))

    merged = F.sort_array(F.concat(
        left["more"], right["more"], ones(left["once"], right["more"]), ones(right["once"], left["more"])))
    single = F.size(F.array_intersect(left["once"], right["once"])).cast("double")
    return ratio(single + F.aggregate(merged, start, step, lambda acc: acc["dot"]), left["norm"] * right["norm"])
