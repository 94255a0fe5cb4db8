"""Source divergence audit: which sources of a language use its vocabulary differently, and which terms they overuse.

Counting is single-pass indexing in memory. A task collects postings (language, term, source: occurrences, documents) until
``RUN_POSTINGS`` of them fill its memory, then spills them as a run sorted by term and cut into chunks by language and hash
shard. A shard's chunks, ordered by their first term, are merged with a heap: a chunk waits in it from when the merge reaches its first
term until its last is passed, so little more than the chunks that overlap is in memory, one for each run. More than ``FAN`` runs are merged in rounds. The result are the
frequencies of each kept term, with its sources.

A group's probability of a term it does not hold is the same for all terms, so a pair's divergence is the one of two empty groups
plus corrections. The terms that only one of the two holds are settled by sorting that group's probabilities once (``one_sided``).
The terms that both hold are streamed term by term (``shared``): sums by pair are kept in memory and given out when there are
``PAIRS_HELD`` of them, so that no list of pairs is ever written out whole. Everything is in whole numbers.

Null text, lang and source are ''. Groups without terms are reported too; a language with one source has no pairs; repeated rows
count each; equal values rank by the item's UTF-8 bytes; no rows give no rows. Texts may be of any length that fits a task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bounded import settled
from . import words as wd
from .common import thrifty, written

LEAST_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
RUN_POSTINGS = 200_000
CHUNK_POSTINGS = 1024
CHUNK_ROWS = 64
MERGE_POSTINGS = 100_000
FAN = 256
SHARDS = 256
PAIRS_HELD = 1_000_000
TILE = 1024

RUN = ("lang string, shard int, run bigint, first binary, terms array<binary>, sources array<string>, counts array<bigint>, "
       "docs array<bigint>")
FREQUENCY = "lang string, term string, docs bigint, total bigint, sources array<string>, counts array<bigint>"


POSTING = [("term", pa.binary()), ("source", pa.string()), ("count", pa.int64()), ("docs", pa.int64())]
RUN_ARROW = pa.schema([
    ("lang", pa.string()), ("shard", pa.int32()), ("run", pa.int64()), ("first", pa.binary()), ("terms", pa.list_(pa.binary())),
    ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())),
])


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def _added(table: pa.Table, *keys: str) -> pa.Table:
    """Rows of equal keys added up."""
    found = table.group_by([*keys]).aggregate([("count", "sum"), ("docs", "sum")])
    return found.rename_columns([c.removesuffix("_sum") for c in found.column_names]).select([*keys, "count", "docs"])


def _postings(column: pa.Array, group: np.ndarray) -> Iterator[pa.Table]:
    """``group, term, count, docs`` of the texts, whose groups are numbers, slab by slab."""
    raw, offsets = wd.buffers(column)
    n_groups = int(group.max(initial=0)) + 1
    for low, high in wd.slabs(offsets):
        words, number, first = wd.distinct(raw, offsets[low:high + 1], wd.LETTERS)
        if not len(number):
            continue
        code = number * n_groups + group[low:high][words.doc]
        order = np.argsort(code, kind="stable")  # texts stay in order within a code
        code, doc = code[order], words.doc[order]
        new = np.concatenate([[True], code[1:] != code[:-1]])
        begin = np.flatnonzero(new)
        n_docs = np.add.reduceat((new | np.concatenate([[True], doc[1:] != doc[:-1]])).astype(np.int64), begin)
        yield pa.table({
            "group": pa.array(code[begin] % n_groups, pa.int32()), "term": wd.spelled(words, first[code[begin] // n_groups]),
            "count": pa.array(np.diff(np.append(begin, len(code)))), "docs": pa.array(n_docs)})


def _shards(terms: pa.Array, shards: int) -> np.ndarray:
    """Each term's shard, by a hash of its bytes; '' has shard 0."""
    raw, offsets = wd.buffers(terms)
    some = np.diff(offsets) > 0
    out = np.zeros(len(terms), np.int32)
    if some.any():
        at = np.flatnonzero(some)
        out[at] = (wd.span_hashes(raw, offsets[at], offsets[at + 1]) % np.uint64(shards)).astype(np.int32)
    return out


def _chunks(table: pa.Table, run: int, size: int) -> Iterator[pa.RecordBatch]:
    """Postings ``lang, shard, term, source, count, docs`` in order as chunks of one language and shard."""
    table = table.combine_chunks()
    n = table.num_rows
    if not n:
        return
    lang = table["lang"].combine_chunks().dictionary_encode().indices.to_numpy()
    shard = table["shard"].to_numpy()
    new = np.concatenate([[True], (lang[1:] != lang[:-1]) | (shard[1:] != shard[:-1])])
    heads = np.flatnonzero(new)
    since = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
    begin = np.flatnonzero(since % size == 0)
    offsets = pa.array(np.append(begin, n).astype(np.int32))
    at = pa.array(begin)
    lists = [pa.ListArray.from_arrays(offsets, table[c].combine_chunks()) for c in ("term", "source", "count", "docs")]
    whole = pa.RecordBatch.from_arrays([
        table["lang"].combine_chunks().take(at), pa.array(shard[begin], pa.int32()), pa.array(np.full(len(begin), run), pa.int64()),
        table["term"].combine_chunks().take(at), *lists], schema=RUN_ARROW)
    for low in range(0, len(begin), 256):
        yield whole.slice(low, 256)


def _sorted_run(held: list[pa.Table], groups: list[tuple[str, str]], run: int, shards: int) -> Iterator[pa.RecordBatch]:
    """The postings as chunks, sorted by language, shard, term and source."""
    table = _added(pa.concat_tables(held), "group", "term").combine_chunks()
    of = table["group"].combine_chunks()
    lang, source = (pa.array([g[i] for g in groups], pa.string()).take(of) for i in (0, 1))
    shard = pa.array(_shards(table["term"].combine_chunks(), shards), pa.int32())
    table = table.drop_columns("group").append_column("lang", lang).append_column("source", source).append_column("shard", shard)
    yield from _chunks(table.sort_by([(c, "ascending") for c in ("lang", "shard", "term", "source")]), run, CHUNK_POSTINGS)


def term_runs(docs: DataFrame, memory: int = RUN_POSTINGS, shards: int = SHARDS) -> DataFrame:
    """Term-sorted runs of postings as chunks; every group of a task has a posting of the term '' in its last run."""
    def build(batches):
        groups: dict[tuple[str, str], int] = {}
        held, size, run = [], 0, TaskContext.get().partitionId() << 24

        def none():
            zero = pa.array(np.zeros(len(groups), np.int64))
            return pa.table({"group": pa.array(range(len(groups)), pa.int32()), "term": pa.array([b""] * len(groups), pa.binary()),
                             "count": zero, "docs": zero})

        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                pairs = zip(part.column("lang").to_pylist(), part.column("source").to_pylist())
                group = np.fromiter((groups.setdefault(p, len(groups)) for p in pairs), np.int64, part.num_rows)
                for found in _postings(part.column("text"), group):
                    held.append(found)
                    size += found.num_rows
                    if size >= 2 * memory:  # add up; a run is full if that does not help
                        held = [_added(pa.concat_tables(held), "group", "term")]
                        size = held[0].num_rows
                        if size >= memory:
                            yield from _sorted_run(held, list(groups), run, shards)
                            held, size, run = [], 0, run + 1
        if groups:
            yield from _sorted_run([*held, none()], list(groups), run, shards)

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*blank).mapInArrow(thrifty(build), _schema(RUN))


def merge_chunks(chunks, block: int = MERGE_POSTINGS) -> Iterator[pa.Table]:
    """Postings ``term, source, count, docs`` in order, equal ones added up, from chunks ordered by their first term.

    ``chunks`` gives ``(first, table)``. Open chunks wait in a heap by their last term. When about ``block`` postings wait, all before
    the first term of the next chunk are complete: they leave whole chunks, and the beginnings of chunks that reach further.
    No term is in two of the tables given.
    """
    heap, waiting, number = [], 0, 0

    def complete(until):
        nonlocal waiting
        parts = []
        while heap and (until is None or heap[0][0] < until):
            parts.append(heapq.heappop(heap)[2])
        if until is not None:
            for i, (last, k, table) in enumerate(heap):
                n = pa.compute.sum(pa.compute.less(table["term"], pa.scalar(until, pa.binary()))).as_py() or 0
                if n:
                    parts.append(table.slice(0, n))
                    heap[i] = last, k, table.slice(n)
        if parts:
            found = _added(pa.concat_tables(parts), "term", "source").sort_by([("term", "ascending"), ("source", "ascending")])
            waiting -= sum(p.num_rows for p in parts)
            yield found

    for first, table in chunks:
        if waiting >= block:
            yield from complete(first)
        heapq.heappush(heap, (table["term"][-1].as_py(), number, table))
        waiting, number = waiting + table.num_rows, number + 1
    yield from complete(None)


def _grouped(batches, names):
    """``(key, chunks)`` for every stretch of rows with one key; chunks are read as they are used."""
    def rows():
        for batch in batches:
            keys = list(zip(*(batch.column(n).to_pylist() for n in names)))
            first = batch.column("first").to_pylist()
            lists = [batch.column(c) for c in ("terms", "sources", "counts", "docs")]
            for i, key in enumerate(keys):
                yield key, (first[i], pa.Table.from_arrays([c[i].values for c in lists], schema=pa.schema(POSTING)))

    source = rows()
    row = next(source, None)

    def stretch(key):
        nonlocal row
        while row is not None and row[0] == key:
            yield row[1]
            row = next(source, None)

    while row is not None:
        key = row[0]
        yield key, stretch(key)


def _shuffled(runs: DataFrame, *more: str) -> DataFrame:
    keys = ["lang", "shard", *more]
    return runs.repartition(*keys).sortWithinPartitions(*keys, "first", "run")


def merged_runs(runs: DataFrame, groups: int) -> DataFrame:
    """Each of ``groups`` sets of runs merged into one."""
    def merge(batches):
        for (lang, shard, part), own in _grouped(batches, ("lang", "shard", "part")):
            for found in merge_chunks(own):
                n = found.num_rows
                found = found.append_column("lang", pa.array([lang] * n, pa.string())).append_column("shard", pa.array(np.full(n, shard), pa.int32()))
                yield from _chunks(found, part, CHUNK_POSTINGS)

    dealt = runs.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(groups)))
    return _shuffled(dealt, "part").mapInArrow(thrifty(merge), _schema(RUN))


def frequencies(runs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, docs, total, sources, counts`` of the terms in at least ``least_docs`` documents, and of the term ''."""
    def merge(batches):
        for (lang, _), own in _grouped(batches, ("lang", "shard")):
            for found in merge_chunks(own):
                found = found.combine_chunks()
                term = found["term"].combine_chunks()
                number = term.dictionary_encode().indices.to_numpy()
                begin = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
                ends = np.append(begin, len(number))
                docs, total = (np.add.reduceat(found[c].to_numpy(), begin) for c in ("docs", "count"))
                names = term.take(pa.array(begin))
                keep = np.flatnonzero((docs >= least_docs) | (pa.compute.binary_length(names).to_numpy() == 0))
                sizes = np.diff(ends)[keep]
                rows = pa.array(np.repeat(begin[keep], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(keep), pa.string()), names.take(pa.array(keep)).cast(pa.string()), pa.array(docs[keep]),
                    pa.array(total[keep]), *(pa.ListArray.from_arrays(offsets, found[c].combine_chunks().take(rows)) for c in ("source", "count")),
                ], [part.split()[0] for part in FREQUENCY.split(", ")])

    return _shuffled(runs).mapInArrow(thrifty(merge), _schema(FREQUENCY))


def probability(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * kept))``, exact."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(19,0)")
    below = F.greatest(total + kept * SMOOTHING, F.lit(1)).cast("decimal(19,0)")
    return (F.call_function("div", above, below) + 1).cast("bigint")


def one_sided(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """``lang, a, b, value`` with a < b, several rows a pair: two empty groups, and terms as if the other group had none."""
    counted = cells.groupBy("lang", "a", "p").agg(F.count("*").alias("m"))
    none = groups.select("lang", "a", F.col("p0").alias("p"), F.lit(0).cast("bigint").alias("m"))
    own = counted.unionByName(none).groupBy("lang", "a").agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("own"))
    others = groups.groupBy("lang", "v").agg(F.sort_array(F.collect_list(F.struct("a", "p0"))).alias("others"))
    rows = own.join(others, "lang")

    def pairs(batches):
        for batch in batches:
            lang = batch.column("lang")
            for i, row in enumerate(batch.select(["a", "v", "own", "others"]).to_pylist()):
                a, p = row["a"], np.array([x["p"] for x in row["own"]], np.int64)
                m = np.array([x["m"] for x in row["own"]], np.int64)
                b = np.array([x["a"] for x in row["others"]], np.int64)
                x = np.array([x["p0"] for x in row["others"]], np.int64)
                upto, sums = np.concatenate([[0], np.cumsum(m)]), np.concatenate([[0], np.cumsum(m * p)])
                at = np.searchsorted(p, x)
                apart = x * upto[at] - sums[at] + (sums[-1] - sums[at]) - x * (upto[-1] - upto[at])
                empty = np.abs(x[np.searchsorted(b, a)] - x)
                value = apart - upto[-1] * empty + np.where(a < b, row["v"] * empty, 0)
                keep = b != a
                b, value = b[keep], value[keep]
                yield pa.RecordBatch.from_arrays([
                    lang.take(pa.array(np.full(len(b), i))), pa.array(np.minimum(a, b), pa.int32()),
                    pa.array(np.maximum(a, b), pa.int32()), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])

    return rows.mapInArrow(pairs, _schema("lang string, a int, b int, value bigint"))


def _corrections(a, p, p0):
    """For terms with equally many groups, rows of ``a, p, p0``: each pair's correction where both hold the term."""
    s = a.shape[1]
    for i in range(0, s, TILE):
        for j in range(i, s, TILE):
            x, y = slice(i, i + TILE), slice(j, j + TILE)
            rows = max(1, (TILE * TILE) // max(1, a[:, x].shape[1] * a[:, y].shape[1]))
            for low in range(0, len(a), rows):
                at = slice(low, low + rows)
                ax, ay = a[at, x][:, :, None], a[at, y][:, None, :]
                px, py, zx, zy = p[at, x][:, :, None], p[at, y][:, None, :], p0[at, x][:, :, None], p0[at, y][:, None, :]
                value = np.abs(px - py) - np.abs(px - zy) - np.abs(py - zx) + np.abs(zx - zy)
                keep = np.broadcast_to(ax < ay, value.shape)
                yield np.broadcast_to(ax, value.shape)[keep], np.broadcast_to(ay, value.shape)[keep], value[keep]


def shared(cells: DataFrame) -> DataFrame:
    """``lang, a, b, value`` with a < b, several rows a pair: corrections for the terms that both groups hold."""
    rows = cells.select("lang", "term", "a", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "a")

    def summed(held: list):
        code, value = (np.concatenate(x) for x in zip(*held))
        pairs, at = np.unique(code, return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, at, value)
        return [(pairs, total)]

    def given(lang, held):
        for pairs, total in held:
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(pairs), pa.string()), pa.array(pairs >> 32, pa.int32()),
                pa.array(pairs & 0xFFFFFFFF, pa.int32()), pa.array(total, pa.int64())], ["lang", "a", "b", "value"])

    def stream(batches):
        lang, held, size = None, [], 0
        for batch in _whole_terms(batches):
            for name, own in _by_lang(batch):
                if name != lang:
                    if held:
                        yield from given(lang, summed(held))
                    lang, held, size = name, [], 0
                term = own.column("term").dictionary_encode().indices.to_numpy(zero_copy_only=False)
                a, p, p0 = (own.column(c).to_numpy().astype(np.int64) for c in ("a", "p", "p0"))
                begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                sizes = np.diff(np.append(begin, len(term)))
                for s in np.unique(sizes[sizes > 1]).tolist():
                    at = begin[sizes == s][:, None] + np.arange(s)
                    for x, y, value in _corrections(a[at], p[at], p0[at]):
                        held.append(((x << 32) | y, value))
                        size += len(x)
                        if size >= PAIRS_HELD:
                            held = summed(held)
                            size = len(held[0][0])
                            if size >= PAIRS_HELD // 2:
                                yield from given(lang, held)
                                held, size = [], 0
        if held:
            yield from given(lang, summed(held))

    return rows.mapInArrow(stream, _schema("lang string, a int, b int, value bigint"))


def _by_lang(batch):
    langs = batch.column("lang").to_pylist()
    low = 0
    while low < len(langs):
        high = low + 1
        while high < len(langs) and langs[high] == langs[low]:
            high += 1
        yield langs[low], batch.slice(low, high - low)
        low = high


def _whole_terms(batches):
    """The rows again, cut so that no term is in two batches."""
    tail = None
    for batch in batches:
        if tail is not None:
            batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        lang, term = batch.column("lang"), batch.column("term")
        last = lang[-1].as_py(), term[-1].as_py()
        low = batch.num_rows - 1
        while low > 0 and (lang[low - 1].as_py(), term[low - 1].as_py()) == last:
            low -= 1
        if low:
            yield batch.slice(0, low)
        tail = batch.slice(low)
    if tail is not None and tail.num_rows:
        yield tail


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, memory: int = RUN_POSTINGS,
          shards: int | None = None, fan: int = FAN) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every (lang, source) its divergence from each other source of the language
    (``pair``) and the ``top_terms`` terms it has more of than its language (``term``).
    """
    spark = docs.sparkSession
    shards = shards or max(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = written(term_runs(docs, memory, shards), "runs")
    n_runs = runs.select("run").distinct().count()
    while n_runs > fan:
        n_runs = -(-n_runs // fan)
        runs = written(merged_runs(runs, n_runs), "runs", CHUNK_ROWS)
    found = written(frequencies(runs, least_docs), "frequencies", CHUNK_ROWS)

    by_lang = found.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("v"), F.sum("total").alias("lang_total"))
    counted = found.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    groups = counted.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("group_total"))
    groups = groups.join(by_lang, "lang")
    zero = F.lit(0).cast("bigint")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = written(groups.withColumns({"a": number, "p0": probability(zero, F.col("group_total"), F.col("v"))}), "groups")

    terms = found.where("term <> ''").select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    cells = terms.select("lang", "term", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    cells = cells.join(settled(groups), ["lang", "source"])
    cells = written(cells.select("lang", "term", "source", "a", "p0", probability(F.col("n"), F.col("group_total"), F.col("v")).alias("p"),
                                 probability(F.col("total"), F.col("lang_total"), F.col("v")).alias("q")), "cells")

    value = one_sided(groups, cells).unionByName(shared(cells)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    value = value.select("lang", "value", both)
    names = groups.select("lang", "a", "source")
    value = value.join(settled(names), ["lang", "a"]).join(
        settled(names.withColumnsRenamed({"a": "b", "source": "item"})), ["lang", "b"])
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pair = value.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    more = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                       (F.col("p") - F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
    return pair.unionByName(more)
