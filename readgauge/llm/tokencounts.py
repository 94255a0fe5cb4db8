"""Token counts that follow edits: a segment tree of runs of pre-tokens per document.

A text is cut into leaves of about LEAF_CHARS at places where a letter, one space and a letter meet. There a pre-token
always begins, whatever stands around, so leaves are encoded alone and their counts add up to the text's. The tree
holds characters and tokens of every subtree, in one array each (root first, children of i at 2i+1 and 2i+2). An edit
descends by characters to the leaves it touches, with one character of context on either side; only those are encoded
again and the sums above them updated.

Null counts as the empty text (0 tokens). Edits outside a text are moved to its end. A text without any such place
is one leaf. Repeated rows each get a row; a null list of edits changes nothing.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import encoder

LEAF_CHARS = 256
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
CUT = re.compile(f"(?<=[{LETTER}]) (?=[{LETTER}])")
EDITS = "array<struct<start:bigint,length:bigint,insert:string>>"


def leaves(text: str, size: int = LEAF_CHARS, most: int | None = None) -> list[str]:
    """Pieces of at least ``size`` characters, cut at safe places; ``most`` of them if given."""
    parts, start = [], 0
    while (most is None or len(parts) < most - 1) and (cut := CUT.search(text, start + size)):
        parts.append(text[start:cut.start()])
        start = cut.start()
    return parts + [text[start:]]


def tree_of(values: list[int]) -> list[int]:
    """Sums of a complete binary tree whose last level holds ``values``, filled up with 0."""
    width = 1 << max(0, len(values) - 1).bit_length()
    level, levels = values + [0] * (width - len(values)), []
    while True:
        levels.append(level)
        if len(level) == 1:
            return [v for row in reversed(levels) for v in row]
        level = [a + b for a, b in zip(level[::2], level[1::2])]


def leaf_at(chars: list[int], offset: int) -> tuple[int, int]:
    """Node of the leaf that holds the character ``offset`` (or the last leaf with text) and the leaf's first character."""
    node, first, width = 0, 0, len(chars) // 2 + 1
    offset = min(offset, max(0, chars[0] - 1))
    while 2 * node + 1 < len(chars):
        left = chars[2 * node + 1]
        if offset - first < left:
            node = 2 * node + 1
        else:
            node, first = 2 * node + 2, first + left
    assert node >= width - 1
    return node, first


def put(tree: list[int], node: int, value: int) -> None:
    change = value - tree[node]
    while change:
        tree[node] += change
        if node == 0:
            break
        node = (node - 1) // 2


def edit(text: str, chars: list[int], tokens: list[int], start: int, length: int, insert: str, count) -> tuple[str, int]:
    """The edited text; updates both trees. Second: the characters that were encoded."""
    start = max(0, min(start, len(text)))
    end = min(len(text), start + max(0, length))
    low, first = leaf_at(chars, max(0, start - 1))
    if first > 0 and start - 1 <= first + 1:  # the cut before this leaf is within reach of the edit
        low, first = leaf_at(chars, first - 1)
    high, at = leaf_at(chars, end + 1)
    region = text[first:start] + insert + text[end:at + chars[high]]
    parts = leaves(region, LEAF_CHARS, high - low + 1)
    parts += [""] * (high - low + 1 - len(parts))
    for node, part in zip(range(low, high + 1), parts):
        put(chars, node, len(part))
        put(tokens, node, count(part))
    return text[:start] + insert + text[end:], len(region)


def counter(vocabulary):
    encode = encoder(vocabulary)
    return lambda part: len(encode.encode_to_numpy(part, disallowed_special=())) if part else 0


def with_trees(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text, edits, chars, tokens``: the texts with both trees. ``docs`` may have ``edits`` (EDITS)."""
    edits = F.col("edits") if "edits" in docs.columns else F.lit(None)
    slim = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"),
                       edits.cast(EDITS).alias("edits"))

    def build(batches):
        count = counter(vocabulary)
        for batch in batches:
            chars, tokens = [], []
            for text in batch.column(1):
                parts = leaves(text.as_py())
                chars.append(tree_of([len(p) for p in parts]))
                tokens.append(tree_of([count(p) for p in parts]))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chars, kind), pa.array(tokens, kind)],
                                             ["doc_id", "text", "edits", "chars", "tokens"])

    return slim.mapInArrow(build, f"doc_id bigint, text string, edits {EDITS}, chars array<int>, tokens array<int>")


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the edits (``doc_id, seq, start, length, insert``) of each document in the order of ``seq``."""
    lists = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "length", "insert"))).alias("e"))
    lists = lists.select("doc_id", F.transform("e", lambda x: F.struct(x["start"], x["length"], x["insert"])).alias("edits"))
    return docs.join(lists, "doc_id", "left")


def apply_edits(state: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """State after the edits: ``doc_id, text, chars, tokens, tokens_before, tokens_after, n_leaves, encoded_chars``."""
    def run(batches):
        count = counter(vocabulary)
        for batch in batches:
            out = [[], [], [], [], [], [], []]
            for text, edits, chars, tokens in zip(*(batch.column(i) for i in (1, 2, 3, 4))):
                text, chars, tokens = text.as_py(), chars.as_py(), tokens.as_py()
                before, encoded = tokens[0], 0
                for e in edits.as_py() or ():
                    text, n = edit(text, chars, tokens, e["start"] or 0, e["length"] or 0, e["insert"] or "", count)
                    encoded += n
                for values, value in zip(out, (text, chars, tokens, before, tokens[0], len(chars) // 2 + 1, encoded)):
                    values.append(value)
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds))],
                ["doc_id", "text", "chars", "tokens", "tokens_before", "tokens_after", "n_leaves", "encoded_chars"])

    return state.mapInArrow(run, "doc_id bigint, text string, chars array<int>, tokens array<int>, tokens_before bigint, "
                                 "tokens_after bigint, n_leaves bigint, encoded_chars bigint")
