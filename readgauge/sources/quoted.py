"""CSV files with quoted line breaks, read by many tasks however large a file is.

Files are read as lines in blocks, as Spark splits them. A line break ends a record if an even number of quotes stand before it in the
file. First every block's quotes are counted, and a running sum over a file's blocks tells which blocks begin inside quotes: only
hashes of those, eight bytes for a block of ``spark.sql.files.maxPartitionBytes``, go to the tasks. Then each task puts
the lines of its blocks together to records. A record belongs to the block it begins in; what of it stands in later blocks, the
few pieces at block ends, is joined on.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_BLOCKS = 5_000_000
RECORDS = "file string, block bigint, n int, kind string, record string"


def _lines(spark: SparkSession, path) -> DataFrame:
    found = spark.read.option("lineSep", "\n").text(path)
    return found.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _inside_starts(lines: DataFrame) -> np.ndarray:
    """Sorted hashes of the blocks that begin inside quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocks.withColumn("odd_before", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).filter("odd_before = 1")
    rows = inside.select(F.xxhash64("file", "block").alias("h")).limit(MOST_BLOCKS + 1).toArrow().column("h").to_numpy()
    if len(rows) > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks begin inside quotes; read fewer files at once or larger blocks")
    return np.sort(rows)


def put_together(lines: Iterator[tuple[str, str, int, bool]]) -> Iterator[tuple[str, int, int, str, str]]:
    """From ``line, file, block, inside`` (whether the block begins inside quotes): ``file, block, n, kind, record``.

    Kinds: ``record``; ``open``, begins here and goes on in the next block; ``tail``, ends a record of an earlier block; ``through``, the whole
    block belongs to one.
    """
    key, inside, parts, n, begun = None, False, [], 0, False
    for line, file, block, start in lines:
        if key != (file, block):
            if parts:
                yield *key, n, "open" if begun else "through", "\n".join(parts)
            key, inside, parts, n, begun = (file, block), start, [], 0, not start
        parts.append(line)
        inside ^= bool(line.count('"') & 1)
        if not inside:
            yield *key, n, "record" if begun else "tail", "\n".join(parts)
            parts, n, begun = [], n + 1, True
    if parts:
        yield *key, n, "open" if begun else "through", "\n".join(parts)


def quoted_records(spark: SparkSession, path) -> DataFrame:
    """``file, block, n, record``: every record once, with the block it begins in and its number there."""
    lines = _lines(spark, path)
    given = spark.sparkContext.broadcast(_inside_starts(lines))

    def run(batches):
        def rows():
            starts = given.value
            for batch in batches:
                hashes = batch.column("h").to_numpy()
                at = np.searchsorted(starts, hashes)
                inside = np.zeros(len(hashes), bool)
                inside[at < len(starts)] = starts[at[at < len(starts)]] == hashes[at < len(starts)]
                yield from zip(batch.column("value").to_pylist(), batch.column("file").to_pylist(),
                               batch.column("block").to_pylist(), inside.tolist())

        held = []
        for record in put_together(rows()):
            held.append(record)
            if len(held) == 2000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    found = lines.withColumn("h", F.xxhash64("file", "block")).mapInArrow(run, RECORDS)
    whole = found.filter("kind = 'record'").select("file", "block", "n", "record")
    # pieces: one or two a block
    order = Window.partitionBy("file").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, 0)
    pieces = found.filter("kind <> 'record'").withColumn("number", F.count_if(F.col("kind") == "open").over(order))
    joined = pieces.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "n", "record"))).alias("p"))
    first = F.col("p")[0]
    text = F.array_join(F.transform("p", lambda x: x["record"]), "\n")
    return whole.unionByName(joined.select("file", first["block"].alias("block"), first["n"].alias("n"), text.alias("record")))


def _batch(rows) -> pa.RecordBatch:
    types = pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()
    names = [part.split()[0] for part in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_quoted_csv(spark: SparkSession, path) -> DataFrame:
    """All columns as strings, named by the files' header, which all files must share. Quotes in quotes are doubled."""
    records = quoted_records(spark, path).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    records = records.filter(F.trim("record") != "")
    is_header = (F.col("block") == 0) & (F.col("n") == 0)
    headers = [r["record"] for r in records.filter(is_header).select("record").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError(f"no common header: {headers}" if headers else f"no header in {path}")
    names = next(csv.reader([headers[0]]))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = F.from_csv("record", F.lit(schema), {"escape": '"', "header": "false", "maxCharsPerColumn": "-1"})
    return records.filter(~is_header).select(parsed.alias("row")).select("row.*")
