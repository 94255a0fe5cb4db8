"""N-gram Jaccard join with several global orders.

A document is the set of its ``n``-word shingles (hashed to 64 bits). Two documents link when the Jaccard similarity of their
sets reaches the threshold; linked documents form components.

Candidates. Under any total order of all shingles, two sets that are similar enough share a shingle among the first
``size - ceil(threshold * size) + 1`` of each (prefix filter). ORDERS different orders are used. All put frequent shingles
last, by a count sketch of the whole corpus whose size is fixed (2 ** SKETCH_BITS cells), and shuffle equals by hashes of their own.
Any one table of classes gives an order, so the sketch may be rough: a task sends about SENT of its cells, the others' counts
being borne by those chosen. The first order's prefix is an inverted index; what it finds must pass the length filter and the positional filter, and must
share enough of its prefix under every other order (``may_link``), before two whole sets are compared.

Work. Equal sets are one node. In each star round a shingle's list is compared with one member of it only, the one with
the shingle at its earliest place, which is a copy's original as a rule; components are then known in large part. The last
round compares all members of a list that are still in different components and were not compared before. So a group of
copies costs a comparison per member, and no link between components is lost. Nothing is capped.

Links. A link's ends are in one component, so the links of a set are counted inside its component: members are dealt by hash to
blocks of about BLOCK_SETS sets or BLOCK_SHINGLES shingles, and every two blocks of a component meet in one group, which
compares all their sets at once. Memory is bounded by two blocks; work is quadratic in a component's different sets.

A null or blank text has no shingles and links with nothing; a text of fewer than ``n`` words is one shingle. Repeated
rows have equal sets and are linked. The component is named by its smallest id; ids compare as numbers, null is last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import bucketed, thrifty, written

ORDERS = 3
SKETCH_BITS = 22
SLICE_BITS = 16
SENT = 200_000
STAR_ROUNDS = 1
CHUNK_BYTES = 500_000
BLOCK_SETS = 1000
BLOCK_SHINGLES = 400_000
COLUMNS_AT_ONCE = 8192


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64), 5)
BASE = 0x5851F42D4C957F2D


POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64 for i < n at least."""
    if len(POWERS.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, factor in (("up", BASE), ("back", pow(BASE, -1, 1 << 64))):
                POWERS[name] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * n, factor, np.uint64)]))
    return POWERS["up"], POWERS["back"]


def shingle_hashes(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts in their order, and how many each text has."""
    words = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    plain = [b" ".join(w) for w in words]
    counts = np.array([len(w) for w in words], np.int64)
    sizes = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    if not sizes.any():
        return np.zeros(0, np.uint64), sizes
    flat = np.frombuffer(b" ".join(plain) + b" ", np.uint8)
    up, back = powers(len(flat) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[flat] * up[:len(flat)], dtype=np.uint64)])
    first_char = np.cumsum([0, *(len(p) + 1 for p in plain)])[:-1]
    gaps = np.flatnonzero(flat == 32)
    ends_before = np.cumsum([0, *np.maximum(counts, 1)])[:-1]  # an empty text is a gap of its own
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first_word = ends_before[doc] + place
    start = np.where(place == 0, first_char[doc], gaps[first_word - 1] + 1)
    end = gaps[first_word + np.minimum(counts[doc], n) - 1]
    with np.errstate(over="ignore"):
        return mixed((sums[end] - sums[start]) * back[start]), sizes


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, sizes = shingle_hashes(texts, n)
    sets = []
    for part in np.split(hashes, np.cumsum(sizes)[:-1]):
        part.sort()
        keep = np.ones(len(part), bool)
        keep[1:] = part[1:] != part[:-1]
        sets.append(part[keep])
    return sets


def chunks(batches):
    """Batches in pieces of about CHUNK_BYTES of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
        piece = np.cumsum(lengths, dtype=np.int64) // CHUNK_BYTES
        bounds = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            yield batch.slice(a, b - a)


def set_keys(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits that stand for a set; null for the empty set."""
    with np.errstate(over="ignore"):
        return [None if not len(s) else mixed(s, 1).sum(dtype=np.uint64).tobytes() + mixed(s, 2).sum(dtype=np.uint64).tobytes()
                for s in sets]


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Estimated counts of the shingles of all documents in 2 ** SKETCH_BITS cells, summed by slice.

    A task keeps a cell with n shingles with probability n / t, then as max(n, t), where t makes about SENT cells of it. So what
    a task sends and what comes back have a fixed size, and no estimate leans to a side.
    """
    slices, width = 1 << (SKETCH_BITS - SLICE_BITS), 1 << SLICE_BITS

    def count(batches):
        cells, total = np.zeros(1 << SKETCH_BITS, np.uint32), 0
        for batch in chunks(batches):
            hashes, _ = shingle_hashes(batch.column(1).to_pylist(), n)
            np.add.at(cells, (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            total += len(hashes)
        least = max(1.0, total / SENT)
        choose = np.random.default_rng(TaskContext.get().partitionId())
        for part in range(slices if total else 0):
            values = cells[part * width:(part + 1) * width]
            at = np.flatnonzero(values)
            at = at[choose.random(len(at)) * least < values[at]]
            if len(at):
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part], pa.int32()), "at": [at.astype("<u2").tobytes()],
                    "n": [np.maximum(values[at], least).astype("<f4").tobytes()]})

    def add(group: pa.Table) -> pa.Table:
        values = np.zeros(width, np.float64)
        for at, counts in zip(group["at"].to_pylist(), group["n"].to_pylist()):
            values[np.frombuffer(at, "<u2")] += np.frombuffer(counts, "<f4")
        return pa.table({"part": group["part"][:1], "n": pa.array([values.astype("<f4").tobytes()], pa.binary())})

    summed = docs.select("doc_id", "text").mapInArrow(thrifty(count), "part int, at binary, n binary").groupBy("part").applyInArrow(
        lambda g: add(g), "part int, n binary")
    cells = np.zeros((slices, width), np.float32)
    for row in summed.collect():
        cells[row["part"]] = np.frombuffer(row["n"], "<f4")
    return cells.ravel()


def classes(cells: np.ndarray) -> np.ndarray:
    """Frequency class of a cell: 0 up to the mean, then one more for each quarter of a doubling, up to 63."""
    mean = max(1.0, float(cells.mean(dtype=np.float64)))
    return np.clip(np.floor(4 * np.log2(np.maximum(cells, 1) / mean)), 0, 63).astype(np.uint8)


def prefix(hashes: np.ndarray, rank: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The prefix of a set under one order, first shingle first."""
    need = -(-percent * len(hashes) // 100)
    length = len(hashes) - need + 1
    cell = rank[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    key = (cell << np.uint64(58)) | (mixed(hashes, 10 + order) >> np.uint64(6))
    if length < len(key):
        near = np.argpartition(key, length - 1)[:length]
        return hashes[near[np.argsort(key[near])]]
    return hashes[np.argsort(key)]


NODE = "pid int, row int, doc_id bigint, key binary, n_shingles bigint, first binary, others array<binary>"


def nodes_of(docs: DataFrame, n: int, percent: int, rank) -> DataFrame:
    """A row per document (as struct ``doc``) with its set's key; the first row of a set in a task also has its prefixes."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    at = docs.columns.index

    def run(batches):
        table, pid, seen, row = rank.value, TaskContext.get().partitionId(), set(), 0
        for whole in batches:
            fields = whole.column(0).flatten()
            ids, texts = fields[at("doc_id")].cast(pa.int64()), fields[at("text")]
            for batch in chunks([pa.RecordBatch.from_arrays([ids, texts, whole.column(0)], ["doc_id", "text", "doc"])]):
                sets = shingle_sets(batch.column(1).to_pylist(), n)
                keys = set_keys(sets)
                prefixes = []
                for key, s in zip(keys, sets):
                    if key is None or key in seen:
                        prefixes.append((None, None))
                        continue
                    seen.add(key)
                    prefixes.append((
                        prefix(s, table, 0, percent).astype("<u8").tobytes(),
                        [(prefix(s, table, o, percent) >> np.uint64(48)).astype("<u2").tobytes() for o in range(1, ORDERS)]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([pid] * len(keys), pa.int32()), pa.array(range(row, row + len(keys)), pa.int32()), batch.column(0),
                    pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x for x, _ in prefixes], pa.binary()), pa.array([x for _, x in prefixes], pa.list_(pa.binary())),
                    batch.column(2),
                ], [part.split()[0] for part in NODE.split(", ")] + ["doc"])
                row += len(keys)

    return packed.mapInArrow(thrifty(run), f"{NODE}, doc {packed.schema['doc'].dataType.simpleString()}")


def set_id() -> Column:
    """A row of the nodes as one number; a set is known by that of its first row."""
    return F.shiftleft(F.col("pid").cast("bigint"), 32) + F.col("row")


def pid_of(key: str) -> Column:
    return F.shiftright(key, 32).cast("int")


def sets_of(nodes: DataFrame) -> DataFrame:
    """``key, id, n_shingles, low``: a row per set, with the smallest doc_id. The row named by ``id`` has the prefixes."""
    return nodes.where("key is not null").groupBy("key").agg(
        F.min(set_id()).alias("id"), F.min("n_shingles").alias("n_shingles"), F.min("doc_id").alias("low"))


def tokens_of(nodes: DataFrame, some: DataFrame) -> DataFrame:
    """``token, key, size, place, root`` of the first order's prefixes of the sets ``key, root``; the table of nodes is not moved."""
    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                parts = [np.frombuffer(x, "<i8") for x in batch.column(3).to_pylist()]
                lengths = np.array([len(p) for p in parts])
                rows = pa.array(np.repeat(np.arange(len(parts)), lengths))
                place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(parts)), *(batch.column(i).take(rows) for i in (0, 1)),
                     pa.array(place.astype(np.int32)), batch.column(2).take(rows)], ["token", "key", "size", "place", "root"])

    slim = nodes.where("first is not null").select("pid", set_id().alias("key"), F.col("n_shingles").cast("int").alias("size"), "first")
    slim = slim.join(some.select("key", "root", pid_of("key").alias("pid")), ["pid", "key"]).select("key", "size", "root", "first")
    return slim.mapInArrow(thrifty(run), "token bigint, key bigint, size int, place int, root bigint")


def lists_of(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Inverted index of the first order's prefixes: ``token, key, size, place``, a set once per list."""
    lists = tokens_of(nodes, sets.select(F.col("id").alias("key"), F.col("id").alias("root"))).drop("root").repartition("token")
    shared = Window.partitionBy("token")
    return lists.withColumn("members", F.count(F.lit(1)).over(shared)).where("members > 1").drop("members")


def with_columns_of(pairs: DataFrame, nodes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Adds ``names`` of both members (suffixed _a and _b); the table of nodes is not moved, only pairs are."""
    for letter in "ab":
        side = nodes.where("first is not null").select(
            F.col("pid").alias(f"pid_{letter}"), set_id().alias(letter), *(F.col(c).alias(f"{c}_{letter}") for c in names))
        pairs = pairs.withColumn(f"pid_{letter}", pid_of(letter)).join(side, [f"pid_{letter}", letter])
    return pairs


def may_link(near_a: list[int], near_b: list[int], size_a: int, size_b: int, percent: int) -> bool:
    """Whether two sets can be similar enough by their prefixes under one order, whose shingles may be cut to some bits.

    What one prefix holds and the other does not is in one of the two sets only: the prefix that ends earlier in the order
    lies wholly where the other set is known. Which it is need not be known, as both must hold too much for a refusal.
    """
    shared = min(sum(map(set(y).__contains__, x)) for x, y in ((near_a, near_b), (near_b, near_a)))  # cut shingles can clash: as many at most
    need = -(-percent * (size_a + size_b) // (100 + percent))
    return shared > 0 and (len(near_a) - shared <= size_a - need or len(near_b) - shared <= size_b - need)


def verified(pairs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` that link: the prefixes of the other orders must meet (by 16 bits of a shingle), then whole sets."""
    def meet(batches):
        for batch in batches:
            near_a, near_b, size_a, size_b = (
                batch.column(batch.schema.names.index(c)).to_pylist() for c in ("near_a", "near_b", "size_a", "size_b"))
            keep = [may_link(np.frombuffer(x, "<u2").tolist(), np.frombuffer(y, "<u2").tolist(), i, j, percent)
                    for x, y, i, j in zip(near_a, near_b, size_a, size_b)]
            yield batch.select(["a", "b", "size_a", "size_b"]).filter(pa.array(keep, pa.bool_()))

    def compare(batches):
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                x, y = (shingle_sets(part.column(part.schema.get_field_index(f"text_{t}")).to_pylist(), n) for t in "ab")
                keep = []
                for a, b in zip(x, y):
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = pairs
    for order in range(ORDERS - 1):  # one order after the other, as few pairs outlive the first
        one = nodes.withColumn("near", F.get("others", F.lit(order)))
        near = with_columns_of(near, one, ("near",)).mapInArrow(thrifty(meet), "a bigint, b bigint, size_a int, size_b int")
    nodes = nodes.withColumn("text", F.col("doc.text"))
    return with_columns_of(near.select("a", "b"), nodes, ("text",)).mapInArrow(thrifty(compare), "a bigint, b bigint")


def components(edges: DataFrame, name: str) -> DataFrame:
    """``key, root`` for every node of ``edges`` (a, b): the smallest key that links reach.

    Each round, a node takes the smallest root of its neighbours' and jumps to its root's root, until nothing changes.
    """
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    state = written(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("root")), name)
    while True:
        near = both.join(state.select(F.col("key").alias("b"), F.col("root").alias("r")), "b").groupBy(
            F.col("a").alias("key")).agg(F.min("r").alias("r"))
        step = state.join(near, "key").select("key", "root", F.least("root", "r").alias("new"))
        above = state.select(F.col("key").alias("new"), F.col("root").alias("up"))
        new = written(step.join(above, "new").select("key", F.col("root").alias("old"), F.least("new", "up").alias("root")), name)
        if not new.where("old != root").limit(1).count():
            return new.select("key", "root")
        state = new.select("key", "root")


def linked_counts(sets: list[np.ndarray], low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """How many links each set has to the others, between the sets marked ``low`` and those marked ``high``, both if one block."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    column = (np.cumsum(times > 1) - 1)[at]  # a shingle of one set only is in no intersection
    row, column = row[times[at] > 1], column[times[at] > 1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a, b = np.flatnonzero(low), np.flatnonzero(high)
    shared = np.zeros((len(a), len(b)), np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
        i, j = np.searchsorted(column, [first, first + COLUMNS_AT_ONCE])
        held = np.zeros((len(sets), min(COLUMNS_AT_ONCE, int(column[-1]) + 1 - first)), np.float32)
        held[row[i:j], column[i:j] - first] = 1
        shared += (held[a] @ held[b].T).astype(np.int64)
    link = 100 * shared >= percent * (sizes[a][:, None] + sizes[b][None, :] - shared)
    link &= a[:, None] != b[None, :]
    counts = np.zeros(len(sets), np.int64)
    counts[a] = link.sum(axis=1)
    if not np.array_equal(a, b):
        counts[b] += link.sum(axis=0)
    return counts


def link_counts(roots: DataFrame, sets: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """``key, n_links``: the links of every set that has any, to sets different from it; all pairs of a component are compared.

    A component of two sets is the link that made it.
    """
    members = written(roots.join(sets.select(F.col("id").alias("key"), "n_shingles"), "key").select("key", "root", "n_shingles"), "members")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.sum("n_shingles").alias("s")).where("k > 2")
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    dealt = members.join(sizes.select("root", blocks.alias("blocks")), "root").select(
        "key", pid_of("key").alias("pid"), "root", "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
    texts = nodes.where("first is not null").select("pid", set_id().alias("key"), F.col("doc.text").alias("text")).join(
        dealt, ["pid", "key"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = texts.select("key", "text", "root", "block", other).select(
        "key", "text", "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block")

    def compare(batches):
        held, name = [], None

        def counted():
            keys, texts, block = (sum((x[i] for x in held), []) for i in range(3))
            block = np.array(block)
            found = linked_counts(shingle_sets(texts, n), block == name[1], block == name[2], percent)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.int64())], ["key", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            root, low, high = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("root", "low", "high"))
            starts = [0, *(i for i in range(1, len(root)) if (root[i], low[i], high[i]) != (root[i - 1], low[i - 1], high[i - 1]))]
            for i, j in zip(starts, [*starts[1:], len(root)]):
                if held and name != (root[i], low[i], high[i]):
                    yield counted()
                    held = []
                name = (root[i], low[i], high[i])
                held.append([batch.column(batch.schema.names.index(c)).slice(i, j - i).to_pylist() for c in ("key", "text", "block")])
        if held:
            yield counted()

    group = ["root", "low", "high"]
    larger = met.repartition(*group).sortWithinPartitions(*group).mapInArrow(thrifty(compare), "key bigint, n bigint")
    twos = members.join(sizes.select("root"), "root", "left_anti").select("key", F.lit(1).cast("bigint").alias("n"))
    return larger.unionByName(twos).groupBy("key").agg(F.sum("n").alias("n_links"))


def grouped(docs: DataFrame, n: int, percent: int, count: bool = True) -> tuple[DataFrame, DataFrame]:
    """The documents as a table (``pid, row, doc``) and, for each, ``pid, row, doc_id, n_shingles, component_id, n_links``.

    Without ``count``, links are not counted and ``n_links`` is missing.
    """
    spark = docs.sparkSession
    rank = spark.sparkContext.broadcast(classes(sketch(docs, n)))  # 2 ** SKETCH_BITS bytes
    nodes = bucketed(nodes_of(docs, n, percent, rank), "nodes", max(1, docs.rdd.getNumPartitions()))
    rows = nodes.select("pid", "row", "doc_id", "key", "n_shingles")
    sets = written(sets_of(nodes), "sets")
    lists = bucketed(lists_of(nodes, sets), "lists", 1, "token")  # not moved again until its open lists are

    def apart(pairs: DataFrame) -> DataFrame:
        """Length and positional filter; the larger place bounds what can still be shared."""
        small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
        need = F.ceil((F.col("size_a") + F.col("size_b")) * percent / (100.0 + percent) - 1e-9)
        left = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
        return pairs.where((small * 100 >= large * percent) & (left >= need)).select(
            "a", "b", "size_a", "size_b").dropDuplicates(["a", "b"])

    def side(df, letter):
        return df.select("token", F.col("key").alias(letter), *(F.col(c).alias(f"{c}_{letter}") for c in ("size", "place", "root")))

    roots, done, links = None, None, None
    for star in range(STAR_ROUNDS + 1):
        state = lists
        if roots is not None:
            linked = tokens_of(nodes, roots).select("token", "key", "root")
            state = lists.join(linked, ["token", "key"], "left").withColumn("root", F.coalesce("root", "key"))
            ends = (f("root").over(Window.partitionBy("token")) for f in (F.min, F.max))
            state = state.withColumns(dict(zip(("low", "high"), ends))).where("low != high").drop("low", "high")
        else:
            state = state.withColumn("root", F.col("key"))
        if star < STAR_ROUNDS:
            # the centre: the earliest place; in later rounds, that of another component
            order = F.struct("place", "size", "key") if star == 0 else F.struct(F.xxhash64("root", F.lit(star)), "place", "key")
            centre = F.min(F.struct(order.alias("o"), "key", "size", "place", "root")).over(Window.partitionBy("token"))
            pairs = state.withColumn("c", centre).where("c.root != root")
            x, y = (F.struct("key", "size", "place"), F.struct("c.key", "c.size", "c.place"))
            pairs = pairs.select(F.when(F.col("key") < F.col("c.key"), x).otherwise(y).alias("x"),
                                 F.when(F.col("key") < F.col("c.key"), y).otherwise(x).alias("y"))
            pairs = pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"), *(
                F.col(f"{s}.{c}").alias(f"{c}_{t}") for s, t in (("x", "a"), ("y", "b")) for c in ("size", "place")))
        else:
            state = written(state, "open")
            pairs = side(state, "a").join(side(state, "b"), "token").where("root_a != root_b and a < b")
        pairs = apart(pairs)
        pairs = written(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        found = written(verified(pairs, nodes, n, percent), "links")
        done = pairs.select("a", "b") if done is None else done.unionByName(pairs.select("a", "b"))
        links = found if links is None else links.unionByName(found)
        roots = components(links, "component")
    named = sets.join(roots.withColumnRenamed("key", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    names = named.join(least, "root").select("key", "id", "component_id")
    found = ["pid", "row", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")]
    if count:
        names = names.join(link_counts(roots, sets, nodes, n, percent).withColumnRenamed("key", "id"), "id", "left")
        found.append(F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return nodes, rows.join(names, "key", "left").select(*found)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row; similarity of ``percent`` hundredths or more links.

    ``n_links`` counts the different sets that the document's set links with; copies have one set.
    """
    _, named = grouped(docs.select("doc_id", "text"), n, percent)
    return named.select("doc_id", "n_shingles", "component_id", "n_links")


def one_per_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, and every row without words."""
    nodes, named = grouped(docs, n, percent, count=False)
    some = named.where("n_shingles > 0").groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "pid", "row")).alias("x")).select("x.pid", "x.row")
    keep = some.unionByName(named.where("n_shingles = 0").select("pid", "row"))
    return nodes.join(keep, ["pid", "row"], "left_semi").select("doc.*")
