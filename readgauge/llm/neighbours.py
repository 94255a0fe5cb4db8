"""Approximate nearest neighbours by cross-polytope hashing.

A vector, made unit and padded to a power of two, is turned by three rounds of random signs and a Hadamard transform
and assigned to the nearest signed axis: its bucket. TABLES independent rotations make as many tables. A query looks
into the PROBES nearest axes of each (multiprobe); all vectors found there are ranked by their exact inner product in double precision.

If lengths differ, stored vectors are divided into classes of like length (each RATIO times shorter than the one before, the last of CLASSES takes
all shorter ones). Within a class a coordinate is added that makes all vectors as long as the class's longest may be, so that the
angle to a query follows the inner product; buckets are those of a class. The classes of the longest vectors, with at least FIRST_SHARE of all,
are searched first. A query then searches every other class whose longest vector could still reach its k-th best product.

Equal vectors are searched once: only the smallest ``k + 1`` ids of a vector can be among anybody's ``k`` nearest, and
equal queries share a search. Buckets beyond BLOCK vectors or queries are split into blocks on either side. Queries that found fewer than ``k`` are
searched again in all buckets of the first table, which is exact. Vectors null, zero, of another length than the longest,
or with null or non-finite components take no part; rows without an id neither; repeated rows of an id count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written

TABLES = 8
PROBES = 20
ROUNDS = 3
SEED = 20
BLOCK = 20_000
RATIO = 1.25
CLASSES = 40
FIRST_SHARE = 0.05
HITS = "key string, ids array<bigint>, scores array<double>"


def hadamard(x: np.ndarray) -> np.ndarray:
    rows, n = x.shape
    h = 1
    while h < n:
        pairs = x.reshape(rows, n // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    signs = np.random.default_rng([seed, table])
    for _ in range(ROUNDS):
        x = hadamard(x * signs.choice([-1.0, 1.0], x.shape[1]))
    return x


def class_of(norms: np.ndarray, longest: float | None) -> np.ndarray:
    """The class of each length: 0 for the longest; all 0 where lengths are equal."""
    if longest is None:
        return np.zeros(len(norms), np.int32)
    return np.clip(np.floor(np.log(longest / norms) / np.log(RATIO) + 1e-12), 0, CLASSES - 1).astype(np.int32)


def prepared(x: np.ndarray, longest: float | None, query: bool) -> np.ndarray:
    """Unit vectors; with ``longest``, stored ones are scaled by their class and filled up by one more coordinate."""
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    if longest is None or query:
        x = x / norms
        extra = np.zeros((len(x), int(longest is not None)))
    else:
        tops = longest * RATIO ** -class_of(norms, longest).astype(float)
        x = x / tops
        extra = np.sqrt(np.maximum(0, 1 - (norms / tops) ** 2))
    width = 1 << (x.shape[1] + extra.shape[1] - 1).bit_length()
    return np.hstack([x, extra, np.zeros((len(x), width - x.shape[1] - extra.shape[1]))])


def axes(x: np.ndarray, table: int, most: int) -> np.ndarray:
    """The ``most`` nearest signed axes per row: 2 i for +i, 2 i + 1 for -i."""
    turned = rotated(x, table)
    near = np.stack([turned, -turned], 2).reshape(len(x), -1)
    most = min(most, near.shape[1])
    return np.argpartition(-near, most - 1, axis=1)[:, :most] if most < near.shape[1] else np.tile(np.arange(most), (len(x), 1))


def packed(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id, vec``: valid vectors as little-endian doubles of their components."""
    v = F.col(vector_column)
    ok = v.isNotNull() & F.col(id_column).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    slim = vectors.where(ok).select(F.col(id_column).cast("bigint").alias("id"), v.cast("array<double>").alias("v"))

    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            flat, ends = np.asarray(lists.flatten(), "<f8"), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], ["id", "vec"])

    return slim.mapInArrow(pack, "id bigint, vec binary")


def matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)


def probed(df: DataFrame, tables: int, most: int, longest: float | None, query: bool) -> DataFrame:
    """``df`` (key, vec, …) once for each bucket: adds the vector's class ``c``, the table ``t`` and the bucket ``b``."""
    schema = df.schema

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                vectors = matrix(batch.column(batch.schema.get_field_index("vec")))
                x = prepared(vectors, longest, query)
                c = class_of(np.linalg.norm(vectors, axis=1), None if query else longest)
                for t in range(tables):
                    b = axes(x, t, most)
                    rows = pa.array(np.repeat(np.arange(len(x)), b.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [*(column.take(rows) for column in batch.columns), pa.array(np.repeat(c, b.shape[1]), pa.int32()),
                         pa.array(np.full(b.size, t, np.int32)), pa.array(b.ravel().astype(np.int32))],
                        [*batch.schema.names, "c", "t", "b"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", c int, t int, b int")


def lengths(queries: DataFrame) -> DataFrame:
    """``key, norm`` of ``vec, key``."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = np.linalg.norm(matrix(batch.column(0)), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n)], ["key", "norm"])

    return queries.select("vec", "key").mapInArrow(run, "key string, norm double")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest scores, ties to smaller ids, each id once."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    return ids[first[:k]], scores[first[:k]]


def ranked(stored: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """HITS of every query in every block: the exact products with all vectors in it."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, ids_out, scores_out = [], [], []
        if left.num_rows and right.num_rows:
            data, names = matrix(left["vec"]), left["ids"].to_pylist()
            sizes = np.array([len(n) for n in names])
            first_id = np.array([n[0] for n in names])
            for i in range(0, right.num_rows, 256):
                part = right.slice(i, 256)
                products = np.array(matrix(part["vec"])) @ data.T
                for key, row in zip(part["key"].to_pylist(), products):
                    if len(row) > k:
                        least = np.partition(row, len(row) - k)[len(row) - k]
                        near = np.flatnonzero(row >= least)
                    else:
                        near = np.arange(len(row))
                    near = near[np.lexsort((first_id[near], -row[near]))]
                    ids = np.array([x for j in near for x in names[j]], np.int64)
                    ids, scores = best(ids, np.repeat(row[near], sizes[near]), k)
                    keys.append(key)
                    ids_out.append(ids)
                    scores_out.append(scores)
        return pa.table({"key": pa.array(keys, pa.string()), "ids": pa.array(ids_out, pa.list_(pa.int64())),
                         "scores": pa.array(scores_out, pa.list_(pa.float64()))})

    place = (*BUCKET, "block", "part")
    return stored.groupBy(*place).cogroup(queries.groupBy(*place)).applyInArrow(lambda a, b: run(a, b), HITS)


def merged(hits: DataFrame, k: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        ids = group["ids"].combine_chunks().flatten().to_numpy()
        scores = group["scores"].combine_chunks().flatten().to_numpy()
        ids, scores = best(ids, scores, k)
        return pa.table({"key": group["key"][:1], "ids": pa.array([ids], pa.list_(pa.int64())),
                         "scores": pa.array([scores], pa.list_(pa.float64()))})

    return hits.groupBy("key").applyInArrow(lambda g: run(g), HITS)


BUCKET = ("c", "t", "b")


def in_blocks(stored: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds to both sides ``block``, of a bucket's vectors, and ``part``, of its queries: every block meets every part.

    Sizes are a row for each bucket, of which there are tables by classes by axes; probes of empty buckets fall away.
    """
    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*BUCKET).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias(name))

    sizes = blocks(stored, "blocks").join(blocks(asked, "parts"), list(BUCKET))

    def side(df: DataFrame, own: str, n_own: str, other: str, n_other: str, key: str) -> DataFrame:
        each = df.join(sizes, list(BUCKET)).withColumn(own, F.pmod(F.xxhash64(key), F.col(n_own)).cast("int"))
        return each.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("blocks", "parts")

    return side(stored, "block", "blocks", "part", "parts", "vec"), side(asked, "part", "parts", "block", "blocks", "key")


def searched(stored: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    return merged(ranked(*in_blocks(stored, asked), k), k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id",
            vector_column: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each row with ``is_query``, itself left out.

    ``is_query`` is a condition on the column ``id``.
    """
    base = written(packed(vectors, id_column, vector_column), "ann-vectors")
    facts = base.agg(F.max(F.length("vec")).alias("bytes")).first()
    if facts["bytes"] is None:
        return base.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"),
                           F.lit(0.0).alias("score"))
    base = base.where(F.length("vec") == facts["bytes"])
    width = 2 * (1 << (facts["bytes"] // 8 - 1).bit_length())

    def norms(batches):
        for batch in batches:
            if batch.num_rows:
                n = np.linalg.norm(matrix(batch.column(0)), axis=1)
                yield pa.RecordBatch.from_pydict({"low": [n.min()], "high": [n.max()]})

    span = base.select("vec").mapInArrow(norms, "low double, high double").agg(F.min("low"), F.max("high")).first()
    longest = span[1] if span[1] > span[0] * 1.0001 else None
    if longest is not None:
        width = 2 * (1 << (facts["bytes"] // 8).bit_length())
    smallest = Window.partitionBy("vec").orderBy("id")
    unique = base.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    unique = unique.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    stored = written(probed(unique, tables, 1, longest, False), "ann-buckets")
    classes = [(r["c"], r["count"]) for r in stored.where("t = 0").groupBy("c").count().orderBy("c").collect()]  # CLASSES at most
    asked = base.where(is_query).select("id", "vec", F.md5("vec").alias("key"))
    single = written(asked.groupBy("vec").agg(F.first("key").alias("key")), "ann-queries")
    probes_of = probed(single, tables, probes, longest, True).drop("c")
    first, held = [], 0
    for c, n in classes:
        if held >= max(FIRST_SHARE * sum(n for _, n in classes), 50 * (k + 1)):
            break
        first, held = [*first, c], held + n
    rest = [c for c, _ in classes if c not in first]
    every = lambda cs: F.explode(F.array(*(F.lit(c).cast("int") for c in cs)))
    hits = searched(stored.where(F.col("c").isin(*first)), probes_of.withColumn("c", every(first)), k + 1)
    hits = written(hits, "ann-hits")
    if rest:  # a class whose longest vector cannot reach the k-th best product has nothing for a query
        tops = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(float(longest * RATIO ** -c)).alias("top")) for c in rest))
        kth = F.coalesce(F.get("scores", F.lit(k)), F.lit(float("-inf")))
        reach = hits.select("key", kth.alias("kth"))
        wanted = lengths(single).join(reach, "key", "left").select("key", F.explode(F.transform(F.filter(
            tops, lambda x: x["top"] * F.col("norm") * (1 + 1e-9) >= F.coalesce("kth", F.lit(float("-inf")))), lambda x: x["c"])).alias("c"))
        more = searched(stored.where(F.col("c").isin(*rest)), probes_of.join(wanted, "key"), k + 1)
        hits = written(merged(hits.unionByName(more), k + 1), "ann-hits")
    few = single.join(hits.where(F.size("ids") > k).select("key"), "key", "left_anti")
    again = probed(few.select("vec", "key"), 1, width, longest, True).withColumn("c", every([c for c, _ in classes]))
    lists = hits.where(F.size("ids") > k).unionByName(searched(stored.where(F.col("t") == 0), again, k + 1))
    return asked.select("id", "key").distinct().join(lists, "key").select(
        F.col("id").alias("query_id"),
        F.posexplode(F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("id")), 1, k)),
    ).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.ids").alias("vec_id"), F.col("col.scores").alias("score"))
