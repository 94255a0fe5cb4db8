"""Order-independent document fingerprints: sums of vectors hashed from paragraphs.

Each paragraph hashes to a wide vector: for each of SEEDS 64 zeros and ones, and for each of WIDE_SEEDS a number below
2 ** WIDE_BITS. A document's fingerprint is the sum of its paragraphs' vectors and their number; lanes of zeros and ones are summed modulo
2 ** LANE_BITS (two lanes share a long, with a bit between them that takes the carry and is cleared), wide numbers modulo 2 ** WIDE_BITS. Sums
don't depend on the order, and a paragraph is inserted or deleted by adding or subtracting its vector. Seen as signs, the lanes of
zeros and ones are random projections of the multiset of paragraphs, so the cosine of two fingerprints estimates the
cosine of the multisets; the wide numbers make different multisets differ.

A paragraph is a line, or a sentence or table cell of it (DELIMITER). Null counts as the empty text, which has the zero
fingerprint; equal texts have equal fingerprints; two empty texts are alike (1), an empty and another are not (0).
Everything is built from SQL functions; a text is one cell and may be of any length, for no cell holds 2 ** LANE_BITS paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELIMITER = r"[\n\r]+\s*|(?<=[.!?|])\s+"
SEEDS = (17, 42)
WIDE_SEEDS = (5, 29, 71, 113)
LANE_BITS = 31
LANES = 32  # longs of two lanes for each seed
WIDE_BITS = 62
PARTS_PER_PARTITION = 4


def paragraphs(text: Column, delimiter: str = DELIMITER) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), delimiter), lambda x: x != "")


def hashed(units: Column, seed: int) -> Column:
    return F.transform(units, lambda x: F.xxhash64(x, F.lit(seed)))


def _both(x: int) -> int:
    return x | x << 32


def lane_mask() -> Column:
    return F.lit(_both((1 << LANE_BITS) - 1)).cast("bigint")


def wide_mask() -> Column:
    return F.lit((1 << WIDE_BITS) - 1).cast("bigint")


def summed(hashes: list[Column], wide: list[Column]) -> Column:
    """``array<bigint>``: the number of units, the lane sums of each seed, two in a long, and the wide sums."""
    zero = F.lit(0).cast("bigint")

    def lane(column: Column, shift: int) -> Column:
        ones = F.lit(_both(1)).cast("bigint")
        return F.aggregate(column, zero, lambda acc, x: (acc + F.shiftrightunsigned(x, shift).bitwiseAND(ones)).bitwiseAND(lane_mask()))

    def total(column: Column) -> Column:
        return F.aggregate(column, zero, lambda acc, x: (acc + x.bitwiseAND(wide_mask())).bitwiseAND(wide_mask()))

    return F.array(F.size(hashes[0]).cast("bigint"), *(lane(h, k) for h in hashes for k in range(LANES)), *map(total, wide))


def with_sums(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the lane sums of ``text`` as ``out``."""
    names = {seed: f"{out}__h{seed}" for seed in (*SEEDS, *WIDE_SEEDS)}
    df = df.withColumn(f"{out}__u", paragraphs(F.col(text)))
    df = df.withColumns({n: hashed(F.col(f"{out}__u"), s) for s, n in names.items()})
    sums = summed([F.col(names[s]) for s in SEEDS], [F.col(names[s]) for s in WIDE_SEEDS])
    return df.withColumn(out, sums).drop(f"{out}__u", *names.values())


def _by_lane(a: Column, b: Column, count, lane, wide) -> Column:
    n = LANES * len(SEEDS)
    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    return F.transform(pairs, lambda p, i: F.when(i == 0, count(p["x"], p["y"])).when(i <= n, lane(p["x"], p["y"])).otherwise(wide(p["x"], p["y"])))


def inserted(sums: Column, more: Column) -> Column:
    """Fingerprint of the union of two multisets of paragraphs."""
    return _by_lane(sums, more, lambda x, y: x + y, lambda x, y: (x + y).bitwiseAND(lane_mask()), lambda x, y: (x + y).bitwiseAND(wide_mask()))


def deleted(sums: Column, less: Column) -> Column:
    """Fingerprint after the deletion of paragraphs that are contained."""
    ahead = F.lit(1 << LANE_BITS).cast("bigint")
    ahead = ahead + F.shiftleft(ahead, 32)  # one whole turn of each lane, so that none borrows from the other
    turn = F.lit(1 << WIDE_BITS).cast("bigint")
    return _by_lane(sums, less, lambda x, y: x - y, lambda x, y: (x.bitwiseOR(ahead) - y).bitwiseAND(lane_mask()),
                    lambda x, y: (x.bitwiseOR(turn) - y).bitwiseAND(wide_mask()))


def as_text(sums: Column) -> Column:
    return F.array_join(F.transform(sums, lambda x: F.lower(F.hex(x))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the signed lanes, cut to 0..1; 1 for equal fingerprints."""
    low = F.lit((1 << LANE_BITS) - 1).cast("bigint")

    def lane(x, i, n):
        return (F.shiftrightunsigned(x, 32 * i).bitwiseAND(low) * 2 - n).cast("double")

    def add(acc, z):
        x, y = z["x"], z["y"]
        pairs = [(lane(x, i, F.element_at(a, 1)), lane(y, i, F.element_at(b, 1))) for i in range(2)]
        return F.struct(
            (acc["xy"] + sum(p * q for p, q in pairs)).alias("xy"),
            (acc["xx"] + sum(p * p for p, _ in pairs)).alias("xx"),
            (acc["yy"] + sum(q * q for _, q in pairs)).alias("yy"),
        )

    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("xy", "xx", "yy")))
    lanes = F.zip_with(F.slice(a, 2, LANES * len(SEEDS)), F.slice(b, 2, LANES * len(SEEDS)),
                       lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    cosine = F.aggregate(lanes, zero, add, lambda s: F.try_divide(s["xy"], F.sqrt(s["xx"] * s["yy"])))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def with_neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``part, doc_id, text, wraps`` and the window in which ``lead`` yields the next document by ascending id.

    Ids are cut into ranges at ids that occur; the rows at each cut are copied into the range before (``ghost``), the
    first ones behind the last. So no range needs another, and rows move once. Null ids come last, ties by text.
    """
    spark = docs.sparkSession
    parts = parts or PARTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    row = slim.agg(
        F.min("doc_id"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * max(parts, 1000)),
    ).first()
    cuts = sorted({row[0], *(row[1] or ())} - {None}) or [0]
    bounds = F.array(*(F.lit(c).cast("bigint") for c in cuts))
    step = 1 << max(0, len(cuts) - 1).bit_length()
    df = slim.withColumn("part", F.lit(0))
    while step:
        df = df.withColumn("part", F.col("part") + F.when(
            F.col("doc_id").isNull() & (F.col("part") + step < len(cuts)), step,
        ).when(F.get(bounds, F.col("part") + step) <= F.col("doc_id"), step).otherwise(0))
        step >>= 1
    first = F.get(bounds, F.col("part")) == F.col("doc_id")
    only_nulls = row[0] is None
    first = F.lit(True) if only_nulls else F.coalesce(first, F.lit(False))
    before = F.when(F.col("part") > 0, F.col("part") - 1).otherwise(len(cuts) - 1)
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"), F.lit(False).alias("wraps"))
    ghost = F.struct(before.alias("part"), F.lit(True).alias("ghost"), (F.col("part") == 0).alias("wraps"))
    placed = df.withColumn("place", F.explode(F.when(first, F.array(own, ghost)).otherwise(F.array(own))))
    return placed.select("doc_id", "text", "place.part", "place.ghost", "place.wraps")


def edited_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint of every text and of its edit with the next document's head.

    The edit replaces the last ``floor(n_chars / 2)`` code points by as many first ones of the next document by
    ascending id (after the last: the first; a single document is its own next). Repeated rows each get a row.
    """
    following = Window.partitionBy("part").orderBy("wraps", F.col("doc_id").asc_nulls_last(), "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = with_neighbours(docs, parts).withColumn("n_chars", F.length("text").cast("bigint"))
    df = df.withColumn("next_text", F.coalesce(F.lead("text").over(following), F.lit("")))
    df = df.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half),
    ))
    df = df.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    df = with_sums(with_sums(df, "text", "own"), "edited", "changed")
    df = df.select(
        "part", "wraps", "ghost", "doc_id", "text", "n_chars", "edited_sha256", "own", "changed",
        F.lead("own").over(following).alias("next_own"),
    ).where(~F.col("ghost"))
    return df.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
