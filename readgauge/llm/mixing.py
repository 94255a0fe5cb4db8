"""Mixing sources to target weights under a curriculum that changes with time.

Every source has a weight and a schedule: its weight's multiplier at the begin and at the end of training, linear between.
Targets share the demand by weight, none above REPEATS times its source (water filling). A source's documents form a
stream in a fixed random order (md5 of the id), repeated as often as the target asks; a document is taken for the part
of the stream before the target. The schedule, integrated, gives a source's cumulative demand at time t; its inverse gives
the time at which a document's words are due: its position in 0..1, one for each pass over the source that takes it.
Positions order the result.

Null texts have no words and are never taken; null ids and null sources are ids and a source like others (null sorts last);
repeated rows each count. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
DEMAND = 1.5
REPEATS = 2
# Multipliers at the begin and the end for the sources of weight 5, 2, 1: broad text first, rare sources later.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
WORD = r"[^\x20\x09-\x0D]+"
SLICES = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def due(share: Column, begin: Column, end: Column) -> Column:
    """Time in 0..1 at which a linear schedule has spent ``share`` of its integral."""
    slope, area = end - begin, (begin + end) / 2
    root = F.sqrt(begin * begin + 2 * slope * area * share)
    return F.when(F.abs(slope) < 1e-12, share).otherwise((root - begin) / slope)


def targets(sources: DataFrame, weights=WEIGHTS, demand: float = DEMAND, repeats: int = REPEATS,
            schedules=SCHEDULES) -> DataFrame:
    """Adds ``weight, begin, end, target`` to one row per source (``source, source_size``).

    The filled target is ``min(cap, weight * level)``: in the order of cap to weight, the level is the first one that
    the next source's cap does not fall below. This table has a row per source, never one per document.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    pick = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), turn + 1)
    df = sources.select(
        "source", "source_size", pick(weights).alias("weight"), pick([s[0] for s in schedules]).alias("begin"),
        pick([s[1] for s in schedules]).alias("end"), (F.col("source_size") * float(repeats)).alias("cap"),
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    df = df.withColumns({
        "filled": F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "asked": F.sum("source_size").over(every) * float(demand), "place": F.row_number().over(order),
    })
    level = (F.col("asked") - F.coalesce("filled", F.lit(0.0))) / F.col("open")
    df = df.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), F.struct("place", level.alias("value"))))
    level = F.min("level").over(every)["value"]
    df = df.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))))
    return df.select("source", "source_size", "weight", "begin", "end", "target")


def mix(docs: DataFrame, weights=WEIGHTS, demand: float = DEMAND, repeats: int = REPEATS, schedules=SCHEDULES,
        size: Column | None = None, slices: int = SLICES, slim: tuple[str, ...] | None = None) -> DataFrame:
    """One row per row of ``docs``: its columns (or those in ``slim``) as struct ``doc``, ``size, source_size, target, taken, position, positions``.

    ``positions`` has one for each pass that takes the document, in order (none: empty); ``position`` is the first, or null.
    A source's stream is cut by the leading digits of the md5 into ``slices``; running sums are taken within a slice
    and over the slices' sums, so a source with a third of all rows spreads over all tasks.
    """
    size = n_words(F.col("text")) if size is None else size
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.struct(*(slim or docs.columns)).alias("doc"), F.col("source").alias("source"), size.alias("size"),
                       key.alias("key"))
    rows = rows.withColumn("slice", F.conv(F.substring("key", 1, 4), 16, 10).cast("int") % 65536 * slices / 65536)
    rows = rows.withColumn("slice", F.floor("slice").cast("int"))
    per_slice = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.withColumn("before", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)))
    sizes = per_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    plan = targets(sizes, weights, demand, repeats, schedules)
    heads = starts.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        F.col("a.source").alias("s"), F.col("slice").alias("p"), "before", "source_size", "target", "begin", "end",
    )
    stream = Window.partitionBy("source", "slice").orderBy("key", "size")
    rows = rows.withColumn("inner", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(heads, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("p")))
    at = F.col("before") + F.col("inner")
    asked = F.floor(F.col("target") + 1e-6).cast("bigint")
    zero = F.lit(0).cast("bigint")
    begins = [at + F.col("source_size") * r for r in range(repeats)]
    parts = [F.greatest(zero, F.least(F.col("size"), asked - b)) for b in begins]
    times = [F.when(part > 0, due(F.least(F.lit(1.0), (b + F.col("size") / 2.0) / asked), F.col("begin"), F.col("end")))
             for b, part in zip(begins, parts)]
    return rows.select(
        "doc", "size", "source_size", "target", sum(parts, zero).cast("bigint").alias("taken"),
        times[0].alias("position"), F.array_compact(F.array(*times)).alias("positions"),
    )


def ordered(mixed: DataFrame) -> DataFrame:
    """Range-sorted by training position; untaken rows last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), F.xxhash64("doc"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The taken documents in training order, each as often as it is begun (its last time may be taken in part).

    Positions are found for keys of the rows alone: the md5 of the id and a hash of all columns. The texts move twice, to meet their
    positions and into the range sort. Equal rows are one text with the positions of all.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    keyed = docs.select(key.alias("_k"), F.xxhash64(*docs.columns).alias("_h"), F.struct(*docs.columns).alias("_doc"))
    size = n_words(F.col("text"))
    slim = docs.select("doc_id", "source", size.alias("_size"), key.alias("_k"), F.xxhash64(*docs.columns).alias("_h"))
    parts = mix(slim, size=F.col("_size"), slim=("_k", "_h"), **parameters)
    places = parts.select("doc._k", "doc._h", F.explode("positions").alias("_position"))
    texts = keyed.dropDuplicates(["_k", "_h"])
    placed = places.hint("merge").join(texts, ["_k", "_h"])
    return placed.orderBy("_position", "_k", "_h").select("_doc.*")
