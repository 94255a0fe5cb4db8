"""Every query against its SQL twin on the smallest tables; the others for their shape and laws."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry_point
from readgauge.plans.catalog import QUERIES
from readgauge.plans.oracles import ORACLES as SQL

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {
    "pca_scores", "pca_loadings", "pca_variance", "logistic_single", "forest_single", "feature_importances",
    "attribution_mean_abs", "subset_sweep", "subset_sweep_records", "forest_sweep", "role_classifier", "role_chain",
    "adjacent_cosine_learned", "feature_table_trained_roles", "word_classes", "content_words_learned",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_only_learned_results_lack_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_entry(spark):
    df = entry_point.entry(spark)
    assert len(df.columns) == 1 + 2 * 14 and df.count() > 0


def test_components_are_orthonormal(spark):
    import numpy as np
    table = QUERIES["pca_loadings"](spark, SF).toPandas().set_index("feature")
    loadings = table.to_numpy()
    assert np.allclose(loadings.T @ loadings, np.eye(loadings.shape[1]), atol=1e-8)
    assert all(column[abs(column).argmax()] > 0 for column in loadings.T)


def test_variance_adds_up(spark):
    rows = QUERIES["pca_variance"](spark, SF).collect()
    ratios = [r["ratio"] for r in rows]
    assert ratios == sorted(ratios, reverse=True)
    assert rows[-1]["cumulative"] == pytest.approx(1)


def test_scores_are_uncorrelated(spark):
    import numpy as np
    scores = QUERIES["pca_scores"](spark, SF).toPandas().drop(columns="doc_id").to_numpy()
    covariance = np.cov(scores.T)
    assert np.allclose(covariance - np.diag(np.diag(covariance)), 0, atol=1e-8)
    assert np.allclose(scores.mean(axis=0), 0, atol=1e-8)


@pytest.mark.parametrize("name", ["logistic_single", "forest_single"])
def test_record_is_consistent(spark, name):
    row = QUERIES[name](spark, SF).first()
    matrix = row["confusion_matrix"]
    assert row["accuracy"] == pytest.approx(sum(matrix[i][i] for i in range(2)) / sum(map(sum, matrix)))
    assert row["accuracy"] > 0.7 and row["class_labels"] == ["abstract", "summary"]
    if name == "forest_single":
        assert sum(row["feature_importances"]) == pytest.approx(1)
    else:
        assert len(row["model_coefficients"]) == 1 and len(row["model_coefficients"][0]) == 14


def test_sweep_covers_all_subsets(spark):
    rows = QUERIES["subset_sweep_records"](spark, SF).collect()
    assert len({tuple(r["feature_combination"]) for r in rows}) == 1001 and all(len(r["feature_combination"]) == 4 for r in rows)
    assert all(r["error"] is None for r in rows)
    best = QUERIES["subset_sweep"](spark, SF).collect()
    assert [r["accuracy"] for r in best] == sorted((r["accuracy"] for r in rows), reverse=True)[:5]


def test_forest_sweep_is_ordered(spark):
    rows = QUERIES["forest_sweep"](spark, SF).collect()
    assert len(rows) == 5 and rows[0]["accuracy"] > 0.7
    assert [r["accuracy"] for r in rows] == sorted((r["accuracy"] for r in rows), reverse=True)


def test_learned_similarity_is_a_cosine(spark):
    rows = QUERIES["adjacent_cosine_learned"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(-1 <= r["similarity"] <= 1 for r in rows) and len({r["similarity"] for r in rows}) > 20


def test_role_chain_learns(spark):
    report = {r["class"]: r for r in QUERIES["role_chain"](spark, SF).collect()}
    assert report["weighted avg"]["f1"] > 0.6


def test_trained_roles_add_up(spark):
    rows = QUERIES["feature_table_trained_roles"](spark, SF).collect()
    sums = {round(sum(r[f"abstract_{x}_ratio"] for x in ("background", "objective", "methods", "results", "conclusions")), 6) for r in rows}
    assert len(rows[0]) == 1 + 2 * 14 and sums <= {0.0, 1.0} and 1.0 in sums


def test_attribution_is_symmetric_for_two_classes(spark):
    rows = {(r["class"], r["feature"]): r["mean_abs"] for r in QUERIES["attribution_mean_abs"](spark, SF).collect()}
    assert len(rows) == 2 * 14
    assert all(value == pytest.approx(rows[1, f]) for (c, f), value in rows.items() if c == 0)


def test_role_classifier_learns(spark):
    report = {r["class"]: r for r in QUERIES["role_classifier"](spark, SF).collect()}
    assert set(report) == {"assistant", "system", "user", "accuracy", "macro avg", "weighted avg"}
    assert report["weighted avg"]["f1"] > 0.4
