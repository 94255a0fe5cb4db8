"""External induced suffix sorting with common prefixes.

Suffixes are sorted as in induced sorting: those that begin a descent-to-ascent (LMS) are sorted first, the others
follow from them in two sweeps over the buckets of first characters. What a sweep induces waits in a priority queue whose
priority is the bucket; a bucket keeps the order of arrival, and what exceeds the memory given to the queue waits on disk.
Every tuple carries the length of its common prefix with the one before it in its bucket: one more than the least
value between their two causes. LMS suffixes are ranked by sorting and naming the substrings between them, which takes a
sweep of the same kind, and by solving the shorter string of names: each level of that recursion doubles the number
of names that have been compared.

Prefixes count up to ``depth`` characters; beyond it the order is not determined. The sweeps work on chunks of a bucket.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

SYMBOLS = 258  # 0 ends the string, 1 ends a piece, byte b is b + 2
CHUNK = 1 << 20
QUEUE_BYTES = 64 << 20


class DiskQueue:
    """Tuples (position, prefix) by bucket, first in, first out; spills to files of ``folder``."""

    def __init__(self, folder: str, name: str, limit: int = QUEUE_BYTES):
        self.folder, self.name, self.limit = folder, name, limit
        self.held: dict[int, list] = {}
        self.files: dict[int, list[int]] = {}
        self.bytes = 0

    def _path(self, bucket: int) -> str:
        return os.path.join(self.folder, f"{self.name}-{bucket}")

    def push(self, bucket: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.held.setdefault(bucket, []).append((positions, prefixes))
        self.bytes += positions.nbytes + prefixes.nbytes
        if self.bytes > self.limit:
            for b, parts in self.held.items():
                with open(self._path(b), "ab") as out:
                    for p, v in parts:
                        out.write(p.astype("<i8").tobytes())
                        out.write(v.tobytes())
                        self.files.setdefault(b, []).append(len(p))
            self.held, self.bytes = {}, 0

    def pop(self, bucket: int, backwards: bool = False) -> list:
        """The bucket's tuples as chunks (positions, prefixes) of at most CHUNK, removed from the queue."""
        parts = []
        if sizes := self.files.pop(bucket, None):
            with open(self._path(bucket), "rb") as rows:
                for n in sizes:
                    parts.append((np.frombuffer(rows.read(8 * n), "<i8"), np.frombuffer(rows.read(n), np.uint8)))
            os.remove(self._path(bucket))
        for part in self.held.pop(bucket, ()):
            self.bytes -= part[0].nbytes + part[1].nbytes
            parts.append(part)
        chunks = joined(parts)
        return chunks[::-1] if backwards else chunks


def joined(parts: list) -> list:
    """Small neighbouring parts as one; a sweep over many tiny chunks would take a call for each."""
    out, held, size = [], [], 0
    for part in parts:
        if held and size + len(part[0]) > CHUNK:
            out.append(tuple(map(np.concatenate, zip(*held))))
            held, size = [], 0
        held.append(part)
        size += len(part[0])
    return out + ([tuple(map(np.concatenate, zip(*held)))] if held else [])


class RangeMin:
    """Least value of ranges of a byte array."""

    def __init__(self, values: np.ndarray, longest: int):
        self.levels = [values]
        width = 1
        while 2 * width <= longest:
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum over low..high-1, 255 for empty ranges."""
        out = np.full(len(low), 255, np.uint8)
        length = high - low
        level = np.zeros(len(low), np.int64)
        full = length > 0
        level[full] = np.frexp(length[full].astype(np.float64))[1] - 1
        for k in np.unique(level[full]):
            at = np.flatnonzero(full & (level == k))
            row = self.levels[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


class Sweep:
    """One sweep: scans buckets in its order and pushes what precedes the scanned suffixes."""

    def __init__(self, text: np.ndarray, depth: int, queue: DiskQueue, upwards: bool):
        """With ``depth`` 0, prefixes are not followed."""
        self.text, self.depth, self.queue, self.upwards = text, depth, queue, upwards
        self.since = np.full(SYMBOLS, 255, np.uint8)  # least prefix since the last push to a bucket
        self.begun = np.zeros(SYMBOLS, bool)

    def rounds(self, bucket: int):
        """What waits in ``bucket``, then what these induce in the bucket itself: runs of its character."""
        chunks, run = self.queue.pop(bucket), 1
        while chunks:
            again, last_least, begun = [], 255, False
            for positions, prefixes in chunks:
                yield positions, prefixes, run
                before = positions - 1
                same = np.flatnonzero((before >= 0) & (self.text[before] == bucket))
                if len(same) and not self.depth:
                    again.append((before[same], np.zeros(len(same), np.uint8)))
                elif len(same):
                    ranges = RangeMin(prefixes, int(max(same[0] + 1, np.diff(same).max(initial=0))))
                    least = ranges.of(np.concatenate([[0], same[:-1] + 1]), same + 1)
                    least[0] = min(int(least[0]), last_least)
                    least = np.minimum(least.astype(np.int64) + 1, self.depth).astype(np.uint8)
                    if not begun:
                        least[0] = min(run, self.depth)
                    again.append((before[same], least))
                    begun, tail = True, prefixes[same[-1] + 1:]
                    last_least = int(tail.min(initial=255))
                else:
                    last_least = min(last_least, int(prefixes.min(initial=255)))
            chunks, run = joined(again), run + 1

    def scan(self, bucket: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Push the characters before these suffixes, to later buckets only."""
        for i in range(0, len(positions), CHUNK):
            self._scan(bucket, positions[i:i + CHUNK], prefixes[i:i + CHUNK])

    def _scan(self, bucket, positions, prefixes):
        before = positions - 1
        symbol = self.text[before]
        later = symbol > bucket if self.upwards else symbol < bucket
        at = np.flatnonzero((before >= 0) & later)
        whole = int(prefixes.min(initial=255))
        if not len(at):
            np.minimum(self.since, whole, out=self.since)
            return
        target = symbol[at]
        order = np.argsort(target, kind="stable")
        at, target = at[order], target[order]
        first = np.ones(len(at), bool)
        first[1:] = target[1:] != target[:-1]
        if not self.depth:
            heads, moved, least = np.flatnonzero(first), before[at], np.zeros(len(at), np.uint8)
            for s, a, b in zip(target[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(at)]):
                self.queue.push(s, moved[a:b], least[a:b])
            return
        low = np.where(first, 0, np.concatenate([[0], at[:-1] + 1]))
        heads = np.flatnonzero(first)
        ends = np.concatenate([heads[1:], [len(at)]]) - 1
        ranges = RangeMin(prefixes, len(prefixes))
        least = ranges.of(low, at + 1)
        symbols = target[heads].astype(np.int64)
        least[heads] = np.minimum(least[heads], self.since[symbols])
        least = np.minimum(least.astype(np.int64) + 1, self.depth).astype(np.uint8)
        least[heads[~self.begun[symbols]]] = 0
        self.begun[symbols] = True
        np.minimum(self.since, whole, out=self.since)
        self.since[symbols] = ranges.of(at[ends] + 1, np.full(len(ends), len(prefixes)))
        moved = before[at]
        for s, a, b in zip(symbols.tolist(), heads.tolist(), (ends + 1).tolist()):
            self.queue.push(s, moved[a:b], least[a:b])


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, up to ``depth``."""
    out = np.zeros(len(a), np.uint8)
    active = np.arange(len(a))
    last = len(text) - 1
    for j in range(depth):
        x, y = a[active] + j, b[active] + j
        equal = (x <= last) & (y <= last)
        equal[equal] = text[x[equal]] == text[y[equal]]
        active = active[equal]
        if not len(active):
            break
        out[active] = j + 1
    return out


def run_length(text: np.ndarray, position: int, depth: int) -> int:
    if not depth:
        return 0
    part = text[position:position + depth]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


class SuffixSorter:
    """Sorts the suffixes of ``text`` (uint16, symbols as above, ending with 0)."""

    def __init__(self, text: np.ndarray, depth: int, folder: str | None = None, queue_bytes: int = QUEUE_BYTES):
        self.text, self.depth, self.queue_bytes = text, depth, queue_bytes
        self.folder = folder
        step = np.sign(text[:-1].astype(np.int32) - text[1:].astype(np.int32)).astype(np.int8)
        # equal neighbours take the type of what follows
        index = np.where(step != 0, np.arange(len(step)), len(step))
        follow = np.minimum.accumulate(index[::-1])[::-1]
        ascends = np.append(np.append(step, 1)[follow] < 0, True)
        self.lms = np.flatnonzero(ascends[1:] & ~ascends[:-1]) + 1

    def _sweeps(self, seeds: np.ndarray, prefixes: np.ndarray, folder: str, depth: int):
        """Chunks (positions, prefixes) of all suffixes in descending order, from LMS suffixes in ascending order."""
        text = self.text
        first = text[seeds]
        bounds = np.searchsorted(first, np.arange(SYMBOLS + 1))
        waiting = DiskQueue(folder, f"l{id(seeds)}", self.queue_bytes)
        kept = DiskQueue(folder, f"k{id(seeds)}", self.queue_bytes)
        sweep = Sweep(text, depth, waiting, True)
        for bucket in range(SYMBOLS):
            run, any_left = 0, False
            for positions, values, run in sweep.rounds(bucket):
                sweep.scan(bucket, positions, values)
                kept.push(bucket, positions, values)
                any_left = True
            own = slice(bounds[bucket], bounds[bucket + 1])
            if own.start < own.stop:
                values = prefixes[own].copy()
                values[0] = min(run, run_length(text, int(seeds[own.start]), depth)) if any_left else 0
                sweep.scan(bucket, seeds[own], values)
        waiting = DiskQueue(folder, f"s{id(seeds)}", self.queue_bytes)
        sweep = Sweep(text, depth, waiting, False)
        for bucket in range(SYMBOLS - 1, -1, -1):
            run, any_left = 0, False
            for positions, values, run in sweep.rounds(bucket):
                sweep.scan(bucket, positions, values)
                any_left = True
                yield positions, values
            above = None  # prefix with the larger neighbour, which the chunk before gives
            for positions, values in kept.pop(bucket, backwards=True):
                down = np.empty_like(values)
                down[1:] = values[:0:-1]
                if above is None:
                    down[0] = min(run, run_length(text, int(positions[-1]), depth)) if any_left else 0
                else:
                    down[0] = above
                above = values[0]
                positions = positions[::-1]
                sweep.scan(bucket, positions, down)
                yield positions, down

    def _ranked(self, folder: str) -> tuple[np.ndarray, np.ndarray]:
        """LMS suffixes in ascending order and their common prefixes."""
        text, lms = self.text, self.lms
        by_char = lms[np.argsort(text[lms], kind="stable")]
        is_lms = np.zeros(len(text), bool)
        is_lms[lms] = True
        found = [p[is_lms[p]] for p, _ in self._sweeps(by_char, np.zeros(len(by_char), np.uint8), folder, 0)]
        order = np.concatenate([*found, lms[-1:]])[::-1]  # the end of the string is induced by nothing
        length = np.zeros(len(text), np.int64)
        length[lms[:-1]] = np.diff(lms) + 1
        length[lms[-1]] = 1
        a, b = order[:-1], order[1:]
        same = length[a] == length[b]
        left = np.flatnonzero(same)
        j = 0
        while len(left):
            x = left[j < length[a[left]]]
            differ = text[a[x] + j] != text[b[x] + j]
            same[x[differ]] = False
            left, j = x[~differ], j + 1
        name = np.zeros(len(text), np.int64)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        rank = name[lms]
        compared = 1
        while compared < self.depth and len(rank) and rank.max() < len(rank) - 1:  # a name spans two characters at least
            shifted = np.zeros(len(rank), np.int64)
            shifted[:-compared] = rank[compared:] + 1
            key = rank * (len(rank) + 1) + shifted
            by_key = np.argsort(key, kind="stable")
            steps = np.concatenate([[0], np.cumsum(key[by_key][1:] != key[by_key][:-1])])
            rank = np.empty(len(rank), np.int64)
            rank[by_key] = steps
            compared *= 2
        order = lms[np.argsort(rank, kind="stable")]
        prefixes = np.concatenate([[np.uint8(0)], common(text, order[:-1], order[1:], self.depth)]).astype(np.uint8)
        return order, prefixes

    def descending(self):
        """All suffixes but the empty one in descending order, in chunks: positions, prefixes with the one before."""
        with tempfile.TemporaryDirectory(dir=self.folder) as folder:
            seeds, prefixes = self._ranked(folder)
            yield from self._sweeps(seeds, prefixes, folder, self.depth)


def pieces_text(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces as one string for SuffixSorter, and the place of each piece's first character."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.ones(int(lengths.sum()) + len(pieces) + 1, np.uint16)
    text[-1] = 0
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    at = np.arange(len(flat)) + np.repeat(np.arange(len(pieces)), lengths)
    text[at] = flat.astype(np.uint16) + 2
    return text, starts
