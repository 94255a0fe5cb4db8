"""What the physical plans must and must not contain."""

import pytest

from readgauge.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
# Small inputs are dealt out over the cores once, which is a round-robin exchange; a shuffle by key is not needed.
ROW_BY_ROW = [
    "extract_after_marker", "prep_min_length", "sentence_split", "word_tokens", "syllables", "fkgl", "fre", "avg_clause_markers",
    "connective_coverage_substring", "connective_coverage_word", "adjacent_cosine_bow", "content_words", "truncate_tokens",
    "hash_split",
]
FITTING = {
    "logistic_single", "forest_single", "feature_importances", "attribution_mean_abs", "subset_sweep", "subset_sweep_records",
    "forest_sweep", "role_classifier", "role_chain", "word_classes",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTING))
def test_no_cross_join(spark, name):
    found = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found


@pytest.mark.parametrize("name", ROW_BY_ROW)
def test_row_measures_shuffle_nothing_by_key(spark, name):
    found = plan(QUERIES[name](spark, SF))
    assert "hashpartitioning" not in found and "SinglePartition" not in found and "BatchEval" not in found


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan(QUERIES["topk_longest"](spark, SF))
    assert "TakeOrderedAndProject" in plan(QUERIES["topk_longest"](spark, SF))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in plan(QUERIES["text_length"](spark, SF))


def test_text_is_taken_apart_once(spark):
    """Each count of the feature table appears once per section, however many measures use it."""
    from readgauge.plans.feature_table import row_measures
    df = spark.read.parquet(f"{SF}/documents.parquet")
    found = plan(row_measures(df, "text", ["doc_id"]))
    assert found.count("split(trim(lower(text") <= 2  # once, and once in the printed alias at most
    assert found.count("[aeiouyAEIOUY]+") == 1
