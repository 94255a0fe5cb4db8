"""Ranked lexical search by presence masks.

A document's score for an item is a sum over the item's terms, each part being the term's weight times its saturated frequency in
the document, all in whole numbers (see ``weight``, ``norm`` and ``part``).

First pass: every task takes the terms of its documents and keeps those that an item has: (document, its number of terms, numbers
and frequencies of its item terms), with sums for document counts. Second pass, over that table: a task takes blocks of
documents. Every term has a bitmap over the block. An item's bitmaps, turned over, give each document the mask of terms it holds;
documents with equal masks are one group. A mask's greatest possible score is the sum of its terms' greatest parts in the block.
Masks are evaluated from the highest such score on, until it falls below the item's k-th best score so far; equality goes on,
for a tie may have a smaller id. A task gives k rows an item, of which a ranking by item keeps k. Nothing is capped but the k.

The items' terms are counted before they are broadcast. Above ``BLOCK_TERMS`` (item, term) pairs the items are dealt into blocks
by hash, each searched against all documents. An item's own terms must fit a task.

Null and blank texts have no terms and are found by nothing; repeated rows are documents each; rows with one item id are one
item with the terms of all; ids of null come last among equal scores; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as wd
from .common import lower_ascii, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 10
BLOCK_TERMS = 1_000_000
BLOCK_DOCS = 1 << 15
BLOCK_POSTINGS = 4_000_000
BITMAP_BYTES = 64 << 20
SCALE = 1_000_000_000


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct ``(item_id, term)``."""
    found = F.regexp_extract_all("text", F.lit(TERM), 0)
    return items.select("item_id", F.explode(found).alias("term")).select("item_id", lower_ascii(F.col("term")).alias("term")).distinct()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norm(n, n_docs: int, length: int):
    return 100 - 90 + (90 * n * n_docs) // length


def part(tf, m):
    return (SCALE * tf) // (1000 * tf + 8 * m)


def term_counts(docs: DataFrame, vocabulary: wd.Vocabulary) -> DataFrame:
    """Rows of two kinds: documents with their item terms, and with ``total`` a task's sums.

    A document: ``doc_id, n`` (its terms with repeats), ``terms, tfs``. Sums: ``n`` of all, ``docs`` counted, document counts.
    """
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([T.StructField("total", T.BooleanType()), T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           *T._parse_datatype_string("n bigint, docs bigint, terms array<int>, tfs array<bigint>").fields])

    def count(batches):
        voc = given.value
        size = len(voc.lengths)
        df, total, n_docs, id_type = np.zeros(size, np.int64), 0, 0, None
        for batch in batches:
            raw, offsets = wd.buffers(batch.column("text"))
            ids = batch.column("doc_id")
            id_type = ids.type
            for low, high in wd.slabs(offsets):
                words = wd.tokenise(raw, offsets[low:high + 1], voc.table, voc.seed)
                n = np.bincount(words.doc, minlength=high - low)
                found = voc.find(words)
                hit = found >= 0
                pairs, tfs = np.unique(words.doc[hit] * max(size, 1) + found[hit], return_counts=True)
                doc, term = pairs // max(size, 1), pairs % max(size, 1)
                df += np.bincount(term, minlength=size)
                total, n_docs = total + int(n.sum()), n_docs + int((n > 0).sum())
                some = np.unique(doc)
                ends = np.append(np.searchsorted(doc, some), len(doc)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(len(some), bool)), ids.slice(low, high - low).take(pa.array(some)),
                    pa.array(n[some], pa.int64()), pa.array(np.ones(len(some)), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(term, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(tfs, pa.int64())),
                ], schema.names)
        if n_docs:
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([
                pa.array([True]), pa.nulls(1, id_type), pa.array([total], pa.int64()), pa.array([n_docs], pa.int64()),
                pa.array([some.tolist()], pa.list_(pa.int32())), pa.array([df[some].tolist()], pa.list_(pa.int64())),
            ], schema.names)

    return docs.select("doc_id", "text").mapInArrow(count, schema)


class Items:
    """The items of a block with their terms and weights, to be broadcast."""

    def __init__(self, ids: pa.Array, terms: list[np.ndarray], weights: np.ndarray, n_docs: int, length: int):
        self.ids, self.terms, self.weights, self.n_docs, self.length = ids, terms, weights, n_docs, length


class Block:
    """Some documents, term by term: for each term its documents and parts, and a bitmap over the documents."""

    def __init__(self, n, terms, tfs, owner, items: Items):
        self.size = len(n)
        parts = part(tfs, norm(n, items.n_docs, items.length)[owner])
        order = np.argsort(terms, kind="stable")
        self.owner, self.parts = owner[order], parts[order]
        self.kinds, self.first = np.unique(terms[order], return_index=True)
        self.first = np.append(self.first, len(order))
        row = np.repeat(np.arange(len(self.kinds)), np.diff(self.first))
        step = -(-self.size // 8)
        bits = np.zeros(len(self.kinds) * step, np.uint8)
        np.bitwise_or.at(bits, row * step + (self.owner >> 3), np.uint8(128) >> (self.owner & 7).astype(np.uint8))
        self.bits = bits.reshape(len(self.kinds), step)
        self.most = np.maximum.reduceat(self.parts, self.first[:-1]) if len(order) else np.zeros(0, np.int64)

    def groups(self, rows: np.ndarray):
        """Masks over the terms ``rows`` (one byte row each), and the documents group by group with their starts."""
        lanes = [np.zeros(self.size, np.uint64) for _ in range(-(-len(rows) // 64))]
        for low in range(0, len(rows), 64):
            held = np.unpackbits(self.bits[rows[low:low + 64]], axis=1, count=self.size)
            packed = np.packbits(held, axis=0)
            wide = np.zeros((self.size, 8), np.uint8)
            wide[:, :len(packed)] = packed.T
            lanes[low // 64] = wide.view(np.uint64)[:, 0]
        order = np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])
        new = np.zeros(self.size, bool)
        new[:1] = True
        for lane in lanes:
            new[1:] |= lane[order][1:] != lane[order][:-1]
        first = np.flatnonzero(new)
        masks = np.concatenate([lane[order[first]].view(np.uint8).reshape(-1, 8) for lane in lanes], axis=1)
        return np.unpackbits(masks, axis=1)[:, :len(rows)].astype(bool), order, np.append(first, self.size)

    def scores(self, rows: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), np.int64)
        for row, w in zip(rows.tolist(), weights.tolist()):
            low, high = self.first[row], self.first[row + 1]
            owner = self.owner[low:high]
            at = np.minimum(np.searchsorted(owner, docs), len(owner) - 1)
            total += np.where(owner[at] == docs, self.parts[low:high][at], 0) * w
        return total


def evaluate(block: Block, terms: np.ndarray, weights: np.ndarray, k: int, floor: int):
    """Documents that can be among the ``k`` best and their scores; none below ``floor``. Also how many were evaluated."""
    at = np.searchsorted(block.kinds, terms)
    here = at < len(block.kinds)
    here[here] = block.kinds[at[here]] == terms[here]
    rows, weights = at[here], weights[here]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    masks, order, first = block.groups(rows)
    bounds = masks @ (weights * block.most[rows])
    turn = np.argsort(-bounds, kind="stable")
    sizes = np.diff(first)[turn]
    reach = np.cumsum(sizes)
    docs, scores, done, ahead = [], np.zeros(0, np.int64), 0, 4 * k
    while done < len(turn) and bounds[turn[done]] >= max(floor, 1):
        stop = int(min(len(turn), max(done + 1, np.searchsorted(reach, (reach[done - 1] if done else 0) + ahead))))
        stop = done + max(1, int(np.searchsorted(-bounds[turn[done:stop]], -max(floor, 1), "right")))
        found = np.concatenate([order[first[g]:first[g + 1]] for g in turn[done:stop].tolist()])
        docs.append(found)
        scores = np.concatenate([scores, block.scores(rows, weights, found)])
        if len(scores) >= k:
            floor = max(floor, int(np.partition(scores, -k)[-k]))
        done, ahead = stop, ahead * 2
    found = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    good = scores >= max(floor, 1)
    return found[good], scores[good], len(scores)


def _blocks(batches):
    """Documents of whole batches, cut into blocks: ids, n, terms, tfs, owner."""
    for batch in batches:
        lists = batch.column("terms")
        offsets = np.asarray(lists.offsets, np.int64)
        terms, tfs = np.asarray(lists.values), np.asarray(batch.column("tfs").values, np.int64)
        n, low = np.asarray(batch.column("n")), 0
        kinds = max(1, len(np.unique(terms)))
        while low < len(n):
            high = int(np.searchsorted(offsets, offsets[low] + BLOCK_POSTINGS, "right")) - 1
            high = min(len(n), max(low + 1, min(high, low + max(8, min(BLOCK_DOCS, 8 * BITMAP_BYTES // kinds)))))
            a, b = offsets[low], offsets[high]
            owner = np.repeat(np.arange(high - low), np.diff(offsets[low:high + 1]))
            yield batch.column("doc_id").slice(low, high - low), n[low:high], terms[a:b].astype(np.int64), tfs[a:b], owner
            low = high


def _joined(batches, rows: int):
    """Batches put together to at least ``rows`` rows, and chunks combined."""
    waiting, count = [], 0
    for batch in batches:
        waiting.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, count = [], 0
    if count:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _order(pair):
    score, doc = pair
    return -score, doc is None, 0 if doc is None else doc


def best_of_tasks(postings: DataFrame, items: Items, k: int, item_field: T.StructField) -> DataFrame:
    """``(item_id, doc_id, score)``: the ``k`` best documents of each item in each task."""
    given = postings.sparkSession.sparkContext.broadcast(items)
    schema = T.StructType([item_field, postings.schema["doc_id"], T.StructField("score", T.LongType())])

    def search(batches):
        items = given.value
        best: list[list] = [[] for _ in items.terms]
        id_type = None
        for ids, n, terms, tfs, owner in _blocks(_joined(batches, BLOCK_DOCS)):
            block, id_type = Block(n, terms, tfs, owner, items), ids.type
            rank = np.asarray(pa.compute.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first"))
            for i, own in enumerate(items.terms):
                floor = best[i][-1][0] if len(best[i]) == k else 0
                docs, scores, _ = evaluate(block, own, items.weights[own], k, floor)
                first = np.lexsort([rank[docs], -scores])[:k]
                if len(first):
                    new = list(zip(scores[first].tolist(), ids.take(pa.array(docs[first])).to_pylist()))
                    best[i] = sorted(best[i] + new, key=_order)[:k]
        rows = [(i, doc, score) for i, found in enumerate(best) for score, doc in found]
        if rows:
            numbers, docs, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [items.ids.take(pa.array(numbers)), pa.array(docs, id_type), pa.array(scores, pa.int64())], schema.names)

    return postings.select("doc_id", "n", "terms", "tfs").mapInArrow(search, schema)


def _search_block(docs: DataFrame, pairs: pa.Table, item_field: T.StructField, k: int) -> DataFrame:
    spark = docs.sparkSession
    terms = pairs.column("term").unique()
    number = pa.compute.index_in(pairs.column("term"), terms).combine_chunks()
    vocabulary = wd.Vocabulary([t.encode() for t in terms.to_pylist()], wd.LETTERS_DIGITS)
    counted = written(term_counts(docs, vocabulary), "postings")
    sums = counted.where("total")
    length, n_docs = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    each = sums.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.tfs").alias("df"))
    df = {r["terms"]: r["df"] for r in each.collect()}
    weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(terms))], np.int64)
    ids = pairs.column("item_id").unique()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    of = np.asarray(pa.compute.index_in(pairs.column("item_id"), ids).combine_chunks(), np.int64)
    order = np.argsort(of, kind="stable")
    own = np.split(np.asarray(number, np.int64)[order], np.flatnonzero(np.diff(of[order])) + 1)
    items = Items(ids, [np.sort(t) for t in own], weights, n_docs, max(length, 1))
    return best_of_tasks(counted.where("NOT total"), items, k, item_field)


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` highest-scoring documents with a score above 0."""
    pairs = written(item_terms(items), "item-terms")
    blocks = max(1, -(-pairs.count() // block))
    item_field, found = items.schema["item_id"], None
    for b in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        part = _search_block(docs, own, item_field, k) if own.num_rows else None
        found = part if found is None else found if part is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], T.StructType([item_field, docs.schema["doc_id"], T.StructField("score", T.LongType())]))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
