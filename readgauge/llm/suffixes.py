"""Exact removal of repeated passages, by suffix arrays of shards.

A byte goes when a string of WINDOW bytes that covers it also starts in a document with a smaller id; matches never
cross documents and are judged on the input. First, shards are made such that all places of a repeated string meet in one:
each window of a text belongs to the rarest-hashed of its GRAM-byte strings (the anchor), which is the same wherever the window
stands, so windows are dealt by anchor. Anchors that stand in one document only are left out; a few bytes per distinct
anchor and pack of documents decide that. The windows of one anchor overlap and travel as one fragment of at most
``2 * WINDOW - GRAM`` bytes, equal ones once per pack. Then every shard's fragments are suffix-sorted (see ``induced``): neighbours with
a common prefix of WINDOW bytes hold the same window, and their smallest document id is the answer.

Texts stay in a table of packs, bucketed so that answers join without moving them; only hashes, fragments and answers are
shuffled. A string that a third of all documents share is one fragment per pack.

Null counts as the empty text. Rows with a null id count as later than all others; rows of equal id don't remove
from each other. Longer documents than PACK_BYTES are a pack of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, thrifty, written
from .induced import SuffixSorter, pieces_text
from .shingles import BASE, BYTE_VALUES, mixed

WINDOW = 50
GRAM = 24
PACK_BYTES = 2_000_000
NO_ID = (1 << 63) - 1
SHARD_BYTES = 4_000_000
PACKS = "pid int, pack bigint, bytes bigint, ids binary, ends binary, text binary"


def packs_of(docs: DataFrame) -> DataFrame:
    """Documents in packs: ids and ends of the texts as little-endian longs, the joined texts, and the other columns."""
    others = [c for c in docs.columns if c != "text"]
    slim = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text", F.struct(*others).alias("rest"))

    def run(batches):
        pid, number = TaskContext.get().partitionId(), 0
        ids, ends, texts, rest, held = [], [], [], [], 0

        def made():
            rows = pa.concat_arrays(rest)
            return pa.RecordBatch.from_arrays([
                pa.array([pid], pa.int32()), pa.array([pid << 32 | number], pa.int64()),
                pa.array([held], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.array(ends, "<i8").tobytes()], pa.binary()),
                pa.array([b"".join(texts)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
            ], ["pid", "pack", "bytes", "ids", "ends", "text", "rest"])

        for batch in batches:
            first = 0
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                text = (text.as_py() or "").encode("utf-8", "replace")
                if ids and held + len(text) > PACK_BYTES:
                    rest.append(batch.column(2).slice(first, i - first))
                    yield made()
                    ids, ends, texts, rest, held, number, first = [], [], [], [], 0, number + 1, i
                held += len(text)
                ids.append(NO_ID if doc_id is None else doc_id)
                ends.append(held)
                texts.append(text)
            rest.append(batch.column(2).slice(first))
        if ids:
            yield made()

    return slim.mapInArrow(thrifty(run), f"{PACKS}, rest array<{slim.schema['rest'].dataType.simpleString()}>")


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash for every GRAM bytes that stand together."""
    with np.errstate(over="ignore"):
        h, width, powers = BYTE_VALUES[data], 1, {}
        while width <= GRAM // 2:
            h = h[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + h[width:]
            width *= 2
            powers[width] = h
        rest = GRAM - width
        if rest:
            h = h[:len(h) - rest] * np.uint64(pow(BASE, rest, 1 << 64)) + powers[rest][width:]
        return mixed(h)


class Anchors:
    """The windows of a pack in fragments: ``first`` window, number ``count``, ``hash`` of the anchor, ``doc`` in the pack."""

    def __init__(self, text: bytes, ends: np.ndarray):
        data = np.frombuffer(text, np.uint8)
        self.first = self.count = self.doc = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if len(data) < WINDOW:
            return
        h = gram_hashes(data)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        span, width = WINDOW - GRAM + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = np.ones(len(anchor), bool)
        for end in ends[:-1]:  # windows that reach over the end of a document
            inside[max(0, end - WINDOW + 1):end] = False
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        starts = np.flatnonzero(new & inside)
        stops = np.flatnonzero(np.append((new | ~inside)[1:], True) & inside) + 1
        self.first, self.count = starts, stops - starts
        self.hash = h[anchor[starts]]
        self.doc = np.searchsorted(ends, starts, side="right")

    def distinct(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes in the order of (bucket, hash), each fragment's place among them, and the hashes in several documents."""
        order = np.lexsort((self.doc, self.hash, self.hash % np.uint64(buckets)))
        h, d = self.hash[order], self.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        several = np.zeros(int(new.sum()), bool)
        several[(np.cumsum(new) - 1)[1:][~new[1:] & (d[1:] != d[:-1])]] = True
        return h[new], place, several


def squeezed(data: bytes) -> bytes:
    """Compressed, behind its length: what is shuffled and written shrinks by half."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def restored(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def read_pack(batch, i: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    value = lambda name: batch.column(batch.schema.get_field_index(name))[i].as_py()
    return np.frombuffer(value("ids"), "<i8"), np.frombuffer(value("ends"), "<i8"), value("text")


def shared_anchors(packs: DataFrame, buckets: int) -> DataFrame:
    """``pid, pack, bits``: for each pack's distinct anchors, in order, one bit: in several documents of all?"""
    def send(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, ends, text = read_pack(batch, i)
                h, _, several = Anchors(text, ends).distinct(buckets)
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                rest = (h // np.uint64(buckets)).astype("<u4")  # the low bits; with the bucket, over 40 bits of the hash
                used = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(used.astype(np.int32)), batch.column(0).take(pa.array([i] * len(used), pa.int64())),
                    batch.column(1).take(pa.array([i] * len(used), pa.int64())),
                    pa.array([rest[cuts[b]:cuts[b + 1]].tobytes() for b in used], pa.binary()),
                    pa.array([np.packbits(several[cuts[b]:cuts[b + 1]]).tobytes() for b in used], pa.binary()),
                ], ["bucket", "pid", "pack", "hashes", "several"])

    def decide(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u4") for x in group["hashes"].to_pylist()]
        sizes = [len(p) for p in parts]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)
                                  for x, n in zip(group["several"].to_pylist(), sizes)])
        h = np.concatenate(parts)
        order = np.argsort(h, kind="stable")
        ordered = h[order]
        equal = np.zeros(len(h), bool)
        equal[1:] = ordered[1:] == ordered[:-1]
        equal[:-1] |= equal[1:].copy()
        several[order] |= equal
        bits = [np.packbits(x).tobytes() for x in np.split(several, np.cumsum(sizes)[:-1])]
        return pa.table({"pid": group["pid"], "pack": group["pack"], "bucket": group["bucket"], "bits": pa.array(bits, pa.binary())})

    sent = packs.mapInArrow(thrifty(send), "bucket int, pid int, pack bigint, hashes binary, several binary")
    told = sent.groupBy("bucket").applyInArrow(lambda g: decide(g), "pid int, pack bigint, bucket int, bits binary")
    return told.groupBy("pid", "pack").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("told"))


FRAGMENTS = ("shard int, pid int, pack bigint, lowest binary, lengths binary, data binary, piece binary, doc binary, "
             "start binary")


def fragments(packs: DataFrame, told: DataFrame, buckets: int, shards: int) -> DataFrame:
    """FRAGMENTS: a row per pack and shard with the distinct fragments, their lowest id, and where they stand in the pack."""
    def run(batches):
        names = [part.split()[0] for part in FRAGMENTS.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ends, text = read_pack(batch, i)
                anchors = Anchors(text, ends)
                h, place, _ = anchors.distinct(buckets)
                cuts = np.searchsorted((h % np.uint64(buckets)).astype(np.int64), np.arange(buckets + 1))
                shared = np.zeros(len(h), bool)
                for answer in batch.column(batch.schema.get_field_index("told"))[i].as_py():
                    a, b = cuts[answer["bucket"]], cuts[answer["bucket"] + 1]
                    shared[a:b] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=b - a)
                chosen = np.flatnonzero(shared[place])
                shard = (mixed(anchors.hash[chosen], 3) % np.uint64(shards)).astype(np.int64)
                chosen = chosen[np.argsort(shard, kind="stable")]
                shard.sort()
                rows = {n: [] for n in names}
                for a, b in zip(bounds := np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else [],
                                [*bounds[1:], len(shard)]):
                    part = chosen[a:b]
                    begins = anchors.first[part]
                    stops = begins + anchors.count[part] + WINDOW - 1
                    index: dict[bytes, int] = {}
                    piece = [index.setdefault(text[s:e], len(index)) for s, e in zip(begins.tolist(), stops.tolist())]
                    lowest = np.full(len(index), NO_ID, np.int64)
                    np.minimum.at(lowest, piece, ids[anchors.doc[part]])
                    for name, value in zip(names, (
                        int(shard[a]), batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), lowest.astype("<i8").tobytes(),
                        bytes(map(len, index)), squeezed(b"".join(index)), squeezed(np.array(piece, "<u4").tobytes()),
                        squeezed(anchors.doc[part].astype("<u4").tobytes()), squeezed(begins.astype("<u4").tobytes()),
                    )):
                        rows[name].append(value)
                if rows["shard"]:
                    types = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in zip(names, types)], names)

    return packs.join(told, ["pid", "pack"]).select("pid", "pack", "ids", "ends", "text", "told").mapInArrow(thrifty(run), FRAGMENTS)


def with_company(pieces: list[bytes]) -> np.ndarray:
    """Whether another piece has the same anchor. Equal windows have equal anchors, so a piece without company shares none.

    All windows of a piece have its least gram as anchor; the high half of its hash tells, and a clash only sorts in vain.
    """
    lengths = np.array([len(p) for p in pieces], np.int64)
    h = gram_hashes(np.frombuffer(b"".join(pieces), np.uint8)) >> np.uint64(32)
    starts = np.cumsum(lengths) - lengths
    bounds = np.stack([starts, starts + lengths - GRAM + 1], axis=1).ravel()
    least = np.minimum.reduceat(np.append(h, np.uint64(1 << 32)), bounds)[::2]
    _, at, n = np.unique(least, return_inverse=True, return_counts=True)
    return n[at] > 1


def lowest_of_pieces(pieces: list[bytes], lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``lowest_documents``, piece after piece, and each one's number of windows; only pieces with company are sorted."""
    counts = np.array([len(p) - WINDOW + 1 for p in pieces], np.int64)
    flat, starts = np.repeat(lowest, counts), np.cumsum(counts) - counts
    several = np.flatnonzero(with_company(pieces)).tolist()
    if several:
        for i, found in zip(several, lowest_documents([pieces[i] for i in several], lowest[several])):
            flat[starts[i]:starts[i] + counts[i]] = found
    return flat, counts


def lowest_documents(pieces: list[bytes], lowest: np.ndarray) -> list[np.ndarray]:
    """For each window of each distinct piece, the smallest ``lowest`` of a piece that holds the window."""
    text, starts = pieces_text(pieces)
    lengths = np.array([len(p) for p in pieces], np.int64)
    owner = np.repeat(np.arange(len(pieces)), lengths + 1)
    best = lowest[np.append(owner, 0)]
    held_at = []

    def close(positions, new):
        """Gives every group of equal windows (from one ``new`` to the next) its smallest id."""
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(positions)))
        best[positions] = np.repeat(np.minimum.reduceat(best[positions], heads), sizes)

    for positions, prefixes in SuffixSorter(text, WINDOW).descending():
        new = prefixes < WINDOW
        heads = np.flatnonzero(new)
        if not len(heads):
            held_at.append(positions)
            continue
        first = np.concatenate([*held_at, positions[:heads[0]]]) if held_at else positions[:heads[0]]
        if len(first):
            close(first, np.arange(len(first)) == 0)
        if heads[-1] > heads[0]:
            close(positions[heads[0]:heads[-1]], new[heads[0]:heads[-1]])
        held_at = [positions[heads[-1]:]]
    if held_at:
        last = np.concatenate(held_at)
        close(last, np.arange(len(last)) == 0)
    return [best[s:s + n - WINDOW + 1] for s, n in zip(starts, lengths)]


ANSWERS = "shard int, pid int, pack bigint, answers binary"
ANSWER = np.dtype([("piece", "<u4"), ("first", "u1"), ("count", "u1"), ("low", "<i8")])


def sorted_shards(parts: DataFrame) -> DataFrame:
    """ANSWERS per pack and shard: runs of windows that stand in a document below all of the pack that hold the fragment."""
    def run(group: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        rows = []
        for low, lengths, data in zip(*(group[n].to_pylist() for n in ("lowest", "lengths", "data"))):
            ends = np.cumsum(np.frombuffer(lengths, np.uint8), dtype=np.int64).tolist()
            data = restored(data)
            own = [index.setdefault(data[a:b], len(index)) for a, b in zip([0, *ends[:-1]], ends)]
            rows.append((np.array(own, np.int64), np.frombuffer(low, "<i8")))
        lowest = np.full(len(index), NO_ID, np.int64)
        for own, low in rows:
            np.minimum.at(lowest, own, low)
        flat, counts = lowest_of_pieces(list(index), lowest)
        starts = np.cumsum(counts) - counts
        piece = np.repeat(np.arange(len(counts)), counts)
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (piece[1:] != piece[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(flat)))
        by_piece = np.searchsorted(piece[heads], np.arange(len(counts) + 1))
        out = []
        for own, low in rows:
            n = np.diff(by_piece)[own]
            runs = np.repeat(by_piece[own], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            local = np.repeat(np.arange(len(own)), n)
            found = flat[heads[runs]]
            keep = found < low[local]
            answer = np.zeros(int(keep.sum()), ANSWER)
            answer["piece"], answer["low"] = local[keep], found[keep]
            answer["first"] = (heads[runs] - starts[piece[heads[runs]]])[keep]
            answer["count"] = sizes[runs][keep]
            out.append(answer.tobytes())
        return pa.table({"shard": group["shard"], "pid": group["pid"], "pack": group["pack"], "answers": pa.array(out, pa.binary())})

    slim = parts.select("shard", "pid", "pack", "lowest", "lengths", "data")
    return slim.groupBy("shard").applyInArrow(lambda g: run(g), ANSWERS)


def removals(row: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends, in the pack, of the bytes that a shard's answers remove."""
    piece, doc, start = (np.frombuffer(restored(row[n]), "<u4").astype(np.int64) for n in ("piece", "doc", "start"))
    lowest = np.frombuffer(row["lowest"], "<i8")
    own = ids[doc]
    begins, ends = [], []
    whole = lowest[piece] < own  # an earlier document of the pack holds the whole fragment
    lengths = np.frombuffer(row["lengths"], np.uint8).astype(np.int64)
    begins.append(start[whole])
    ends.append(start[whole] + lengths[piece[whole]])
    answers = np.frombuffer(row["answers"] or b"", ANSWER)
    by_piece = np.searchsorted(answers["piece"], np.arange(len(lowest) + 1))
    left = np.flatnonzero(~whole)
    n = np.diff(by_piece)[piece[left]]
    pick = np.repeat(by_piece[piece[left]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    holder = np.repeat(left, n)
    hit = answers["low"][pick] < own[holder]
    first = start[holder[hit]] + answers["first"][pick[hit]].astype(np.int64)
    begins.append(first)
    ends.append(first + answers["count"][pick[hit]] + WINDOW - 1)
    return np.concatenate(begins), np.concatenate(ends)


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """RESULT per row of ``docs``; with ``with_text`` also ``kept_text``, the kept bytes without broken characters, and the
    row's other columns as struct ``rest``."""
    docs = docs if with_text else docs.select("doc_id", "text")
    parts = max(1, docs.select("text").rdd.getNumPartitions())
    packs = bucketed(packs_of(docs), "packs", parts)
    shards = 16 + (packs.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES
    buckets = 2 * parts
    told = shared_anchors(packs, buckets)
    pieces = written(fragments(packs, told, buckets, shards), "fragments")
    answers = sorted_shards(pieces)
    # dealt by pid like the buckets: the joins and the grouping below move nothing more
    wide = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = pieces.select("shard", "pid", "pack", "lowest", "lengths", "piece", "doc", "start").repartition(wide, "pid").join(
        answers.repartition(wide, "pid"), ["shard", "pid", "pack"], "left")
    fields = ("lowest", "lengths", "piece", "doc", "start", "answers")
    found = found.groupBy("pid", "pack").agg(F.collect_list(F.struct(*fields)).alias("found"))

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ends, text = read_pack(batch, i)
                change = np.zeros(len(text) + 1, np.int32)
                for row in batch.column(batch.schema.get_field_index("found"))[i].as_py() or ():
                    begins, stops = removals(row, ids)
                    np.add.at(change, begins, 1)
                    np.add.at(change, stops, -1)
                gone = np.cumsum(change[:-1]) > 0
                data = np.frombuffer(text, np.uint8)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                out = [[], [], [], [], []]
                for a, b in zip(starts.tolist(), ends.tolist()):
                    removed = gone[a:b]
                    kept = text[a:b] if not removed.any() else data[a:b][~removed].tobytes()
                    spans = int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum())
                    for values, value in zip(out, (b - a, b - a - len(kept), spans, hashlib.sha256(kept).hexdigest(),
                                                   kept.decode("utf-8", "ignore") if with_text else None)):
                        values.append(value)
                arrays = [pa.array([None if x == NO_ID else x for x in ids.tolist()], pa.int64())]
                arrays += [pa.array(v, t) for v, t in zip(out, [pa.int64()] * 3 + [pa.string()] * 2)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
                if with_text:
                    arrays.append(batch.column(batch.schema.get_field_index("rest"))[i].values)
                    names.append("rest")
                yield pa.RecordBatch.from_arrays(arrays if with_text else arrays[:5], names if with_text else names[:5])

    joined = packs.join(found, ["pid", "pack"], "left").select("pid", "pack", "ids", "ends", "text", "found", *["rest"] * with_text)
    kind = packs.schema["rest"].dataType.elementType.simpleString()
    return joined.mapInArrow(thrifty(cut), RESULT + f", kept_text string, rest {kind}" * with_text)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept text, and ``n_chars`` counted anew where there is such a column."""
    cut = remove_repeats(docs, with_text=True)
    columns = {c: F.col("kept_text") if c == "text" else F.col("rest")[c] for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(column.alias(name) for name, column in columns.items()))
