"""Words of many texts at once: their places in the bytes, hashes, and exact comparison of what the hashes say is equal.

A word is a maximal run of word bytes. All bytes of a character beyond ASCII are word bytes, so runs of bytes are the runs of
characters that the contracts' patterns name. Only A-Z are lower-cased. Hashes only find candidates: ``equal`` compares the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLAB_BYTES = 2 << 20
HASH_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def word_bytes(digits: bool) -> np.ndarray:
    """True for the bytes of words: letters of ASCII, with ``digits`` 0-9 too, and all of other characters."""
    table = np.zeros(256, bool)
    table[0x80:] = True
    for low, high in ("AZ", "az", *(["09"] if digits else [])):
        table[ord(low):ord(high) + 1] = True
    return table


LETTERS, LETTERS_DIGITS = word_bytes(False), word_bytes(True)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ np.uint64((seed * _BASE + 0x632BE59BD9B4E019) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(HASH_BYTES.bit_length(), int(n).bit_length())
    if size not in _TABLES:
        _TABLES[size] = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
    return _TABLES[size]


@dataclass
class Words:
    """``starts, ends``: byte places in ``raw`` (lower-cased); ``doc``: the text's number; ``hashes``."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i]:self.ends[i]].tobytes()


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    values = mixed(np.arange(1, 257, dtype=np.uint64), seed + 1)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # stretches of bytes, so that the wide sums stay small
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + HASH_BYTES, "right")))
        high = ends[j - 1]
        powers, inverse = _tables(high - low + 1)
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[raw[low:high]] * powers[:high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mixed(out, seed)


def tokenise(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, seed: int = 0) -> Words:
    """The words of the texts ``raw[offsets[i]:offsets[i + 1]]``, in order; none goes over a text's end."""
    raw = LOWER[raw[offsets[0]:offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = table[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    before[firsts] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[firsts[firsts > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    return Words(raw, starts, ends, doc, _hashes(raw, starts, ends, seed))


def equal(raw_a, start_a, raw_b, start_b, lengths) -> np.ndarray:
    """Whether the spans of the given lengths hold the same bytes."""
    out = np.ones(len(lengths), bool)
    step = max(1, int(SLAB_BYTES // max(1, int(lengths.max(initial=0)))))
    for i in range(0, len(lengths), step):
        size = lengths[i:i + step]
        first = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(first[-1]) - np.repeat(first[:-1], size)
        same = raw_a[np.repeat(start_a[i:i + step], size) + at] == raw_b[np.repeat(start_b[i:i + step], size) + at]
        bad = np.concatenate([[0], np.cumsum(~same)])
        out[i:i + step] = bad[first[1:]] == bad[first[:-1]]
    return out


def distinct(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, each one's number among the distinct words, and an occurrence of each distinct word."""
    seed = 0
    while True:  # another hash if two different words share one
        words = tokenise(raw, offsets, table, seed)
        _, firsts, number = np.unique(words.hashes, return_index=True, return_inverse=True)
        lengths = words.ends - words.starts
        of = firsts[number]
        if (lengths == lengths[of]).all() and equal(words.raw, words.starts, words.raw, words.starts[of], lengths).all():
            return words, number, firsts
        seed += 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of lower-cased bytes, in the order of their places; the same everywhere."""
    return _hashes(raw, starts, ends, 0)


def spelled(words: Words, which: np.ndarray) -> pa.Array:
    """The bytes of some of the words."""
    starts, lengths = words.starts[which], (words.ends - words.starts)[which]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = words.raw[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


class Vocabulary:
    """A set of words as sorted hashes and bytes, to be broadcast: ``find`` gives each word's number or -1."""

    def __init__(self, words: list[bytes], table: np.ndarray):
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        for seed in range(64):
            hashes = tokenise(raw, offsets, table, seed).hashes
            if len(np.unique(hashes)) == len(words):
                break
        self.table, self.seed, self.raw = table, seed, raw
        self.number = np.argsort(hashes)
        self.hashes, self.starts, self.lengths = hashes[self.number], offsets[:-1], np.diff(offsets)

    def find(self, words: Words) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(words.starts), -1)
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        found = np.where(self.hashes[at] == words.hashes, self.number[at], -1)
        hit = np.flatnonzero(found >= 0)
        sizes = (words.ends - words.starts)[hit]
        hit_word = found[hit]
        fits = sizes == self.lengths[hit_word]
        found[hit[~fits]] = -1
        hit, hit_word, sizes = hit[fits], hit_word[fits], sizes[fits]
        wrong = ~equal(words.raw, words.starts[hit], self.raw, self.starts[hit_word], sizes)
        found[hit[wrong]] = -1
        return found


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slabs(offsets: np.ndarray, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high
