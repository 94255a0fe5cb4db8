"""Sentence, word and syllable expressions.

Counts are taken with whole-text regular expressions rather than by walking an
array of words with lambdas, so that they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \n\t\r"
WORD = r"[\p{L}\p{N}]+"
WORD_OR_MARK = r"[\p{L}\p{N}]+|[^\p{L}\p{N} \n\t\r]"
WORD_START = r"(?<![\p{L}\p{N}])"
WORD_END = r"(?![\p{L}\p{N}])"
TOKEN_PATTERNS = {"words": WORD, "words+punct": WORD_OR_MARK}

_VOWELS = "aeiouyAEIOUY"
_VOWEL_RUN = f"[{_VOWELS}]+"
_CONSONANT = rf"[\p{{L}}\p{{N}}&&[^{_VOWELS}]]"
_HARD_CONSONANT = rf"[\p{{L}}\p{{N}}&&[^{_VOWELS}lL]]"
_FINAL_E = f"{_HARD_CONSONANT}[eE]{WORD_END}"
_NO_VOWEL_BUT_FINAL_E = (
    f"{WORD_START}{_CONSONANT}++(?:{WORD_END}|(?<={_HARD_CONSONANT})[eE]{WORD_END})"
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def sentences(text: Column) -> Column:
    """Non-empty sentences: cut after a run of ``.!?`` that blanks follow."""
    clean = trimmed(text)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(
        F.split(clean, r"(?<=[.!?])[ \n\t\r]+")
    )


def lower_sentences(text: Column) -> Column:
    return sentences(F.lower(text))


def sentence_count(text: Column) -> Column:
    """``size(sentences(text))`` without building the array."""
    return _count(text, r"[.!?][ \n\t\r]++(?!\z)") + text.rlike(r"[^ \n\t\r]").cast("long")


def words(text: Column, tokens: str = "words") -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERNS[tokens]), F.lit(0))


def lower_words(text: Column) -> Column:
    return words(F.lower(text))


def word_count(text: Column, tokens: str = "words") -> Column:
    return _count(text, TOKEN_PATTERNS[tokens])


def truncated(tokens: Column, n: int) -> Column:
    """The first ``n`` tokens."""
    return F.slice(tokens, 1, n)


def syllable_count(text: Column) -> Column:
    """Total syllables of all words.

    A word has one syllable per run of vowels, less one for a final ``e`` that
    follows a consonant other than ``l`` when there are several runs, and at
    least one. Summed over the text this is: vowel runs, minus words with such a
    final ``e``, plus words whose only vowel it is or that have none at all.
    """
    return _count(text, _VOWEL_RUN) - _count(text, _FINAL_E) + _count(text, _NO_VOWEL_BUT_FINAL_E)


def any_word_of(words) -> str:
    """A pattern for any of the given lower-case words or phrases as whole words.

    Common beginnings are written once, so a position is dismissed by its first letters, before the letter ahead of it is looked at.
    """
    firsts = sorted({w[:1] for w in words})
    ahead = f"(?=[{''.join(firsts)}])" if firsts and all(c.isalnum() for c in firsts) else ""
    return f"{ahead}{WORD_START}(?:{_by_prefix(set(words))}){WORD_END}"


def _by_prefix(words: set[str]) -> str:
    branches = []
    for first in sorted({w[0] for w in words if w}):
        rests = {w[1:] for w in words if w.startswith(first)}
        branches.append(first + (rests.pop() if len(rests) == 1 else f"(?:{_by_prefix(rests)})"))
    return "|".join(branches + [""] * ("" in words))


def shortest_parts(terms) -> list[str]:
    """Terms to look for as substrings, short ones first, without those that contain another."""
    terms = sorted(set(terms), key=lambda t: (len(t), t))
    return [t for t in terms if not any(o != t and o in t for o in terms)]
