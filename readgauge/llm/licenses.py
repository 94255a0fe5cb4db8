"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a set of words: those of a line of a document, or of a stretch of it that may cross line ends and has at most as
many words as the template's text, so wrapped notices are found. It matches a template when it holds at least THRESHOLD of the
template's words, all of the words that name it and none of those that name a variant (CC BY and CC BY-NC). Words are ordered
by their number of documents, rare ones first, counted over all documents. By the prefix filter a match must hold one of the
template's first ``len - need + 1`` words; by the length filter the block has at least ``need`` words; by the positional
filter, the words before the first one found are lost, so the rest must still reach ``need``. Stretches are looked for in
documents that pass these filters as one set. What is left is verified word by word. Templates are a parameter; their words
are the only thing that is sent to every task, so its size is that of the templates.

Null counts as the empty text: no words, no labels, score 0. Repeated rows each get a row.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
# Phrases whose words stand consecutively, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Customary short notices: label, text, words that a match must hold, words that it must not hold.
TEMPLATES = (
    ("mit", "released under the MIT License", "mit", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "", "organization font"),
    ("apache", "licensed under the Apache License version 2.0", "apache", ""),
    ("gpl", "licensed under the GNU General Public License version 3", "general", "lesser"),
    ("gpl", "redistribute it and or modify it under the terms of the GNU General Public License", "general", "lesser"),
    ("lgpl", "licensed under the GNU Lesser General Public License", "lesser", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "", ""),
    ("mpl", "subject to the terms of the Mozilla Public License version 2.0", "mozilla", ""),
    ("cc-by", "licensed under CC BY 4.0", "cc by", "nc sa nd"),
    ("cc-by-nc", "licensed under CC BY NC 4.0", "cc by nc", ""),
    ("cc-by-sa", "licensed under CC BY SA 4.0", "cc by sa", ""),
)
SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
          "labels string, score double, blocks array<int>")
# A-Z to a-z; digits, letters and bytes from 128 on are parts of words, all else parts them; line feeds stay.
PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256)
)


def words_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(PLAIN)


def document_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Number of documents that hold each word of ``vocabulary``, over all documents; a row per word comes back."""
    def counts(batches):
        found = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in batch.column(0):
                for word in vocabulary.intersection(words_of(text.as_py()).split()):
                    found[word] += 1
        yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())},
                                         pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(counts, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {bytes(r["word"]): r["n"] for r in rows.collect()}


class Template(NamedTuple):
    label: str
    ordered: list[bytes]
    need: int
    length: int
    own: set[bytes]
    foreign: set[bytes]


def template_index(templates, counts: dict[bytes, int], threshold: float) -> dict[bytes, list[tuple]]:
    """Prefix word -> templates, each with the place of the word. Own and foreign words may be left out of ``templates``."""
    index: dict[bytes, list[tuple]] = {}
    for label, text, *names in templates:
        own, foreign = (set(words_of(t).split()) for t in (*names, "", "")[:2])
        words = words_of(text).split()
        ordered = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
        need = math.ceil(threshold * len(ordered) - 1e-9)
        template = Template(label, ordered, need, len(words), own, foreign)
        for place, word in enumerate(ordered[:len(ordered) - need + 1]):
            index.setdefault(word, []).append((template, place))
    return index


def candidates(words: set[bytes], index: dict[bytes, list[tuple]]):
    """Templates that ``words`` hold enough of, with the number of words shared; one may come several times."""
    for word in words & index.keys():
        for template, place in index[word]:
            if len(words) < template.need or len(template.ordered) - place < template.need or not template.own <= words:
                continue
            shared = sum(w in words for w in template.ordered)
            if shared >= template.need:
                yield template, shared


def block_matches(words: set[bytes], index: dict[bytes, list[tuple]]) -> dict[str, float]:
    """Label -> largest share of a template's words among the block's, for templates that meet the threshold."""
    found: dict[str, float] = {}
    for template, shared in candidates(words, index):
        if not template.foreign & words:
            found[template.label] = max(found.get(template.label, 0.0), shared / len(template.ordered))
    return found


def stretches(words: list[bytes], template: Template) -> list[tuple[int, int]]:
    """Words shared and first word's place of stretches that match; of stretches that overlap, the best and earliest.

    A stretch that starts at a word of the template or its own and ends before a foreign word holds all that others there hold.
    """
    every, found = set(template.ordered), []
    told = every | template.own | template.foreign
    hits = [(i, w) for i, w in enumerate(words) if w in told]
    held: dict[bytes, int] = {}
    end = 0
    for start, (at, word) in enumerate(hits):
        if word in template.foreign:
            continue
        end = max(end, start)
        while end < len(hits) and hits[end][0] < at + template.length and hits[end][1] not in template.foreign:
            held[hits[end][1]] = held.get(hits[end][1], 0) + 1
            end += 1
        shared = len(held.keys() & every)
        if shared >= template.need and template.own <= held.keys():
            found.append((shared, at))
        held[word] -= 1
        if not held[word]:
            del held[word]
    kept: list[tuple[int, int]] = []
    starts: dict[int, list[int]] = {}  # by cells of a stretch's length; those that overlap are at most one cell apart
    for shared, at in sorted(found, key=lambda x: (-x[0], x[1])):
        cell = at // template.length
        if not any(abs(at - s) < template.length for c in (cell - 1, cell, cell + 1) for s in starts.get(c, ())):
            starts.setdefault(cell, []).append(at)
            kept.append((shared, at))
    return kept


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases=None) -> DataFrame:
    """One row per document (SCHEMA): word and phrase counts, labels, best share, and the numbers of the lines on which matches begin."""
    phrases = {tuple(p.encode().split()): label for p, label in (PHRASES if phrases is None else phrases).items()}
    vocabulary = {w for _, text, *_ in templates for w in words_of(text).split()}
    index = template_index(templates, document_counts(docs, vocabulary), threshold)
    last_words = {p[-1] for p in phrases}
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.int32())]

    def places(words):
        found = []
        for end, word in enumerate(words):
            if word in last_words:
                for phrase, label in phrases.items():
                    start = end + 1 - len(phrase)
                    if start >= 0 and tuple(words[start:end + 1]) == phrase:
                        found.append((start, label))
        return found

    def scanned(batches):
        for batch in batches:
            columns = {n: [] for n in names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                plain = words_of(text.as_py())
                words = plain.split()
                distinct = set(words)
                base = places(words) if last_words & distinct else []
                labels, blocks = {}, set()
                near = {id(t): t for t, _ in candidates(distinct, index)}.values()
                if near:
                    lines = [line.split() for line in plain.split(b"\n")]
                    for number, line in enumerate(lines):
                        if got := block_matches(set(line), index):
                            blocks.add(number)
                            labels = {k: max(v, labels.get(k, 0.0)) for k, v in {**labels, **got}.items()}
                    ends = list(accumulate(map(len, lines)))
                    for template in near:
                        for shared, at in stretches(words, template):
                            blocks.add(bisect_right(ends, at))
                            share = shared / len(template.ordered)
                            labels[template.label] = max(labels.get(template.label, 0.0), share)
                base_labels = {label for _, label in base}
                starts = [s for s, _ in base]
                for name, value in zip(names, (
                    doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base_labels)), ",".join(sorted(base_labels | labels.keys())),
                    max(labels.values(), default=0.0), sorted(blocks),
                )):
                    columns[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in zip(names, types)], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scanned, SCHEMA)
