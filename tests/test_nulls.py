"""Null and repeated ids in the feature table."""

import pytest

from readgauge.functions import lexicon
from readgauge.plans.feature_table import feature_table

PAIRS = [("a", "One two three. Four five.", "Six seven eight."), (None, "Nine ten eleven twelve.", "One two. Three two."),
         ("a", "Other words stand here.", "")]
ROLES = [f"{s}_{r}_ratio" for s in ("abstract", "summary") for r in lexicon.ROLES]


def roles_of(spark, *ids):
    rows = [(i, *[float(n)] * len(ROLES)) for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "doc_id string, " + ", ".join(f"{c} double" for c in ROLES))


def test_a_null_id_keeps_its_measures(spark):
    pairs = spark.createDataFrame(PAIRS, "doc_id string, abstract string, summary string")
    table = feature_table(pairs, roles=roles_of(spark, "a", None)).collect()
    assert sorted(r["abstract_length"] for r in table) == [4, 4, 5]
    (nameless,) = [r for r in table if r["doc_id"] is None]
    assert nameless["abstract_ppl"] > 1 and nameless["summary_ppl"] > 1 and nameless["abstract_cwe"] is not None
    assert nameless["abstract_background_ratio"] == 1


def test_repeated_roles_are_an_error(spark):
    pairs = spark.createDataFrame(PAIRS, "doc_id string, abstract string, summary string")
    with pytest.raises(Exception, match="several rows of roles"):
        feature_table(pairs, roles=roles_of(spark, "a", "a")).collect()
