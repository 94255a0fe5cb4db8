"""Benchmark decontamination: a broadcast set of hashed benchmark n-grams, held against every word window of the documents.

An item's windows are its ``n`` consecutive words; an item of fewer words, but not none, is one window. Distinct (window, item)
pairs are counted first. At most ``BLOCK_WINDOWS`` of them are broadcast at once; a larger benchmark is dealt into blocks by
hash, and the documents pass over the blocks one after the other, carrying what was hit so far. So the broadcast never grows
with the benchmark. A window whose hash is in the set is verified word by word.

A word inside any window that occurs is hit. ``scan`` gives the hit stretches and items; ``clean`` removes the stretches, or the
whole document where the hits make up too much of it.

Documents without text have no words; rows that share an id are judged each on its own; a table without rows gives none, an
empty benchmark hits nothing. Benchmark items with one id are one item; a null id is written as an empty one. Texts may be of
any length that fits a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as wd
from .common import lower_ascii, written

WINDOW = 10
BLOCK_WINDOWS = 400_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A document with at least this share of its words hit goes as a whole.
MOST_HIT = 0.5
FILTER_BITS = 6  # cells of the first filter for each window, as a power of two
SPANS = "array<struct<first:int,last:int,start:int,end:int>>"


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct ``(item, size, window)``: the words of a window with blanks between them."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(WORD), 0)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words"))
    items = items.where(F.size("words") > 0).withColumn("size", F.least(F.size("words"), F.lit(n)))
    windows = F.expr("transform(sequence(1, size(words) - size + 1), i -> array_join(slice(words, i, size), ' '))")
    return items.select("item", "size", F.explode(windows).alias("window")).distinct()


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each ``n`` consecutive words."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k:k + count]
    return wd.mixed(out)


class Grams:
    """Windows of one block: by size, sorted hashes, where the words stand, and the items of each window."""

    def __init__(self, rows: list[tuple[str, int, str]]):
        by_window: dict[tuple[int, str], list[str]] = {}
        for item, size, window in rows:
            by_window.setdefault((size, window), []).append(item)
        keys = list(by_window)
        texts = [w.encode() for _, w in keys]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        words = wd.tokenise(self.raw, offsets, wd.LETTERS_DIGITS)
        self.starts, self.lengths = words.starts, words.ends - words.starts
        first = np.searchsorted(words.doc, np.arange(len(keys)))
        sizes = np.array([size for size, _ in keys], np.int64)
        self.items = [by_window[k] for k in keys]
        self.sizes = {}
        for size in np.unique(sizes):
            rows_of = np.flatnonzero(sizes == size)
            padded = np.concatenate([words.hashes, np.zeros(size, np.uint64)])
            hashes = window_hashes(padded, size)[first[rows_of]]
            order = np.argsort(hashes)
            bits = max(10, int(len(order)).bit_length() + FILTER_BITS)
            seen = np.zeros(1 << bits, bool)
            seen[hashes >> np.uint64(64 - bits)] = True
            self.sizes[int(size)] = hashes[order], rows_of[order], first[rows_of][order], bits, np.packbits(seen)

    def occurrences(self, words: wd.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(size, first word, window)`` of the windows that occur, verified."""
        lengths = words.ends - words.starts
        for size, (hashes, window, first, bits, seen) in self.sizes.items():
            found = window_hashes(words.hashes, size)
            cell = found >> np.uint64(64 - bits)
            at = np.flatnonzero((seen[cell >> np.uint64(3)] >> (7 - (cell & np.uint64(7))).astype(np.uint8)) & 1)
            at = at[words.doc[at] == words.doc[at + size - 1]]
            low = np.searchsorted(hashes, found[at])
            high = np.searchsorted(hashes, found[at], "right")  # several windows may share a hash
            count = high - low
            place = np.repeat(at, count)
            k = np.repeat(low, count) + np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
            same = np.ones(len(place), bool)
            for j in range(size):
                a, b = place + j, first[k] + j
                same &= lengths[a] == self.lengths[b]
                left = np.flatnonzero(same)
                same[left] = wd.equal(words.raw, words.starts[a[left]], self.raw, self.starts[b[left]], lengths[a[left]])
            yield size, place[same], window[k[same]]


def _scan_rows(raw, offsets, spans: list, items: list, grams: Grams):
    """For the texts of a slab: number of words, hit stretches and items, with those known before."""
    n = len(offsets) - 1
    words = wd.tokenise(raw, offsets, wd.LETTERS_DIGITS)
    first = np.searchsorted(words.doc, np.arange(n + 1))
    change = np.zeros(len(words.starts) + 1, np.int64)
    for i, known in enumerate(spans):
        for span in known or ():
            change[first[i] + span["first"]] += 1
            change[first[i] + span["last"] + 1] -= 1
    found = [set(known or ()) for known in items]
    for size, place, window in grams.occurrences(words):
        np.add.at(change, place, 1)
        np.add.at(change, place + size, -1)
        pairs = np.unique(np.stack([words.doc[place], window]), axis=1)
        for i, w in pairs.T.tolist():
            found[i].update(grams.items[w])
    hit = np.cumsum(change[:-1]) > 0
    begins = hit & ~np.concatenate([[False], hit[:-1]])
    stops = hit & ~np.concatenate([hit[1:], [False]])
    edge = first[:-1][first[:-1] < len(hit)]
    begins[edge] = hit[edge]
    stops[edge[edge > 0] - 1] = hit[edge[edge > 0] - 1]
    a, b = np.flatnonzero(begins), np.flatnonzero(stops)
    out: list[list[dict]] = [[] for _ in range(n)]
    base = offsets - offsets[0]
    for i, j in zip(a.tolist(), b.tolist()):
        d = int(words.doc[i])
        out[d].append({"first": i - int(first[d]), "last": j - int(first[d]), "start": int(words.starts[i] - base[d]),
                       "end": int(words.ends[j] - base[d])})
    return np.diff(first), out, [sorted(f) for f in found]


def _pass(docs: DataFrame, grams: Grams) -> DataFrame:
    """One block's windows over all documents: ``doc, n_words, spans, items``."""
    given = docs.sparkSession.sparkContext.broadcast(grams)
    schema = T.StructType([docs.schema["doc"], T.StructField("n_words", T.LongType()),
                           *T._parse_datatype_string(f"spans {SPANS}, items array<string>").fields])

    def scan_batches(batches):
        for batch in batches:
            doc = batch.column("doc")
            raw, offsets = wd.buffers(doc.field("text") if not doc.null_count else doc.flatten()[doc.type.get_field_index("text")])
            for low, high in wd.slabs(offsets):
                part = batch.slice(low, high - low)
                n, spans, items = _scan_rows(raw, offsets[low:high + 1], part.column("spans").to_pylist(),
                                             part.column("items").to_pylist(), given.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array(n, pa.int64()), pa.array(spans, batch.schema.field("spans").type),
                     pa.array(items, batch.schema.field("items").type)], ["doc", "n_words", "spans", "items"])

    return docs.select("doc", "spans", "items").mapInArrow(scan_batches, schema)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: its columns as struct ``doc``, ``n_words, n_hit, spans, items``.

    ``spans``: the hit stretches in order, each with its first and last word and its first byte and the byte after its last.
    ``items``: ids of the items with an occurring window, as sorted strings.
    """
    windows = written(item_windows(benchmark, n), "windows")
    blocks = max(1, -(-windows.count() // block))
    part = F.pmod(F.xxhash64("item", "window"), F.lit(blocks))
    empty = F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *empty)
    for b in range(blocks):
        grams = Grams([tuple(r) for r in windows.where(part == b).collect()])
        if b:
            rows = written(rows, "scanned")
        rows = _pass(rows, grams)
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["last"] - x["first"] + 1)
    return rows.select("doc", "n_words", hits.alias("n_hit"), "spans", "items")


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, most: float = MOST_HIT) -> DataFrame:
    """The columns of ``docs`` without the hit stretches of the texts; documents with a share of ``most`` hit words or more go.

    A column ``n_chars`` is counted anew where a text changed.
    """
    scanned = scan(docs, benchmark, n)
    kept = scanned.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.lit(most) * F.col("n_words")))
    schema = T.StructType(docs.schema.fields)

    def cut(batches):
        for batch in batches:
            doc, spans = batch.column("doc"), batch.column("spans").to_pylist()
            columns = dict(zip([f.name for f in doc.type], doc.flatten()))
            texts = columns["text"].to_pylist()
            changed = [i for i, s in enumerate(spans) if s]
            for i in changed:
                raw, at, parts = texts[i].encode(), 0, []
                for span in spans[i]:
                    parts.append(raw[at:span["start"]])
                    at = span["end"]
                texts[i] = b"".join([*parts, raw[at:]]).decode()
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                counts = columns["n_chars"].to_pylist()
                for i in changed:
                    counts[i] = len(texts[i])
                columns["n_chars"] = pa.array(counts, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return kept.select("doc", "spans").mapInArrow(cut, schema)
