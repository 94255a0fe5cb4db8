"""The operators as queries over the whole test tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (
    decontaminate, divergence, fingerprints, lexical, licenses, mixing, neighbours, packing, quality, shingles, suffixes,
    tokencounts, urlfilter,
)
from .common import table
from .oracles import ORACLES  # noqa: F401

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents")
    scored = quality.QualityModel.fit(docs).score(docs)
    return scored.select("doc.doc_id", "n_words", F.round("weak_bad", 6).alias("weak_bad"),
                         F.round("quality", 6).alias("quality"), "keep")


@query
def op2_suffix_array_dedup(spark, sf):
    return suffixes.remove_repeats(table(spark, sf, "documents"))


@query
def op3_ngram_jaccard(spark, sf):
    return shingles.near_duplicates(table(spark, sf, "documents"), n=4, percent=85)


@query
def op4_document_fingerprints(spark, sf):
    return fingerprints.edited_fingerprints(table(spark, sf, "documents"))


@query
def op5_license_scans(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


@query
def op6_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), with_ids=False)


@query
def op7_mixing(spark, sf):
    mixed = mixing.ordered(mixing.mix(table(spark, sf, "documents").select("doc_id", "source", "text"), slim=("doc_id",)))
    return mixed.select("doc.doc_id", "size", "source_size", "target", "taken", "position", "positions")


@query
def op8_token_counts(spark, sf):
    docs = table(spark, sf, "documents")
    middle = F.floor(F.length("text") / 2)
    edits = F.array(F.struct(middle.alias("start"), F.lit(32).cast("bigint").alias("length"),
                             F.concat_ws(" ", "source", "lang").alias("insert")))
    state = tokencounts.with_trees(docs.select("doc_id", "text", edits.alias("edits")))
    return tokencounts.apply_edits(state).select("doc_id", "tokens_before", "tokens_after", "n_leaves", "encoded_chars")


@query
def op9_url_filters(spark, sf):
    return urlfilter.judge(table(spark, sf, "pages"))


@query
def op10_nearest_neighbours(spark, sf):
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("id") % 20 == 0)


@query
def op11_benchmark_decontamination(spark, sf):
    found = decontaminate.scan(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        decontaminate.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op12_ranked_search(spark, sf):
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op13_source_divergence(spark, sf):
    return divergence.audit(table(spark, sf, "documents"))
