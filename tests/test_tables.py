import numpy as np
import pytest
from pyspark.sql import functions as F

from readgauge.operators import joins, metrics, profile, reshape, roles


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


WIDE = [("elife-1", 1.0, 2.0, 5.0), ("Journal.2", 3.0, None, 6.0), ("z", 0.0, 1.0, 7.0)]


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(WIDE, "doc_id string, abstract_f double, summary_f double, abstract_abstract_g double")


def test_unpivot_strips_only_the_leading_prefix(wide):
    assert reshape.paired_features(wide.columns) == ["f"]
    got = wide.withColumn("summary_abstract_g", F.lit(1.0))
    assert reshape.paired_features(got.columns) == ["abstract_g", "f"]
    assert rows(reshape.long_features(wide), "doc_id", "type") == [
        ("Journal.2", "abstract", 3.0), ("Journal.2", "summary-plos", None),
        ("elife-1", "abstract", 1.0), ("elife-1", "summary-elife", 2.0), ("z", "abstract", 0.0), ("z", "summary", 1.0),
    ]


def test_select_by_target(wide):
    chosen, found = reshape.select_by_target(wide, "summary")
    assert found == ["summary_f"] and chosen.columns == ["doc_id", "summary_f"] and chosen.count() == 3
    none, found = reshape.select_by_target(wide, "nothing")
    assert found == [] and none.columns == ["doc_id"] and none.count() == 0


def test_schema_profile(wide):
    got = {r["column"]: (r["group"], r["feature"], r["in_both"], r["n_rows"]) for r in reshape.schema_profile(wide).collect()}
    assert got["doc_id"] == ("other", "doc_id", False, 3)
    assert got["abstract_f"] == ("abstract", "f", True, 3)
    assert got["abstract_abstract_g"] == ("abstract", "abstract_g", False, 3)


def test_unknown_class(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "type string")
    assert reshape.label_from_map(df, {"a": 0}, on_unknown="drop").collect()[0]["label"] == 0
    with pytest.raises(Exception, match="unknown class"):
        reshape.label_from_map(df, {"a": 0}).collect()
    with pytest.raises(ValueError):
        reshape.label_from_map(df, {"a": 0}, on_unknown="ignore")


def test_concat_keeps_order_of_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, 0.5)], "id int, b double")
    both = reshape.concat_tables([a, b])
    assert both.columns == ["id", "a", "b"] and rows(both, "id") == [(1, "x", None), (2, None, 0.5)]


def frames(spark):
    a = spark.createDataFrame([("1", 1), ("2", 2), ("2", 3), (None, 4)], "doc_id string, v int")
    b = spark.createDataFrame([("2", 5), ("2", 6), ("3", 7)], "doc_id string, v int")
    c = spark.createDataFrame([("1", 8), ("4", 9), (None, 10)], "doc_id string, w int")
    return a, b, c


def test_merge_multiplies_repeats_and_keeps_all_keys(spark):
    a, b, c = frames(spark)
    merged = joins.merge_features([a, b, c])
    assert merged.columns == ["doc_id", "v_x", "v_y", "w"]
    expected = {("1", 1, None, 8), ("2", 2, 5, None), ("2", 2, 6, None), ("2", 3, 5, None), ("2", 3, 6, None),
                ("3", None, 7, None), ("4", None, None, 9), (None, 4, None, 10)}
    found = [tuple(r) for r in merged.collect()]
    assert set(found) == expected and len(found) == len(expected)


def test_merge_shuffles_each_frame_once(spark):
    # a chain of full outer joins would shuffle the joined rows again for each further frame
    parts = [spark.range(1000).select(F.col("id").alias("doc_id"), F.col("id").alias(f"c{i}")) for i in range(4)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.merge_features(parts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 5


def test_merge_of_unique_keys(spark):
    a, b, c = (f.filter("v is null or v < 0 or true") if "v" in f.columns else f for f in frames(spark))
    with pytest.raises(Exception, match="repeated key"):
        joins.merge_features([a, b, c], unique_keys=True).collect()
    a, b = a.dropDuplicates(["doc_id"]), b.dropDuplicates(["doc_id"])
    one, two = (joins.merge_features([a, b, c], unique_keys=u).select("doc_id", "w") for u in (True, False))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_null_profile_and_duplicates(wide):
    assert rows(profile.null_profile(wide), "column") == [("summary_f", 1)]
    both = wide.union(wide.limit(1))
    assert rows(profile.duplicate_keys(both), "doc_id") == [(wide.limit(1).first()["doc_id"], 2)]


@pytest.mark.parametrize("size", [1, 2, 3, 10, 1001])
@pytest.mark.parametrize("accuracy", [100, 100_000])
def test_describe_matches_numpy(spark, size, accuracy):
    rng = np.random.default_rng(size)
    columns = {"ties": rng.integers(0, 4, size).astype(float), "normal": rng.normal(size=size), "skew": rng.exponential(size=size) ** 4}
    data = [tuple(float(columns[c][i]) for c in columns) for i in range(size)] + [(None, None, None)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in columns)).repartition(5)
    for row in profile.describe(df, list(columns), accuracy).collect():
        x = columns[row["feature"]]
        assert row["count"] == size and row["mean"] == pytest.approx(x.mean())
        assert [row["min"], row["q25"], row["q50"], row["q75"], row["max"]] == pytest.approx(
            [x.min(), *np.quantile(x, [0.25, 0.5, 0.75]), x.max()]
        )
        assert row["std"] == (pytest.approx(x.std(ddof=1)) if size > 1 else None)


def test_histogram_edges_and_constant(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 0.5), ("b", None)], "g string, v double")
    assert rows(profile.feature_histogram(df, "v", "g", 2), "g", "bin") == [
        ("a", 0, 1), ("a", 1, 1), ("b", 0, 0), ("b", 1, 1)]
    constant = spark.createDataFrame([("a", 2.0)] * 3, "g string, v double")
    assert rows(profile.feature_histogram(constant, "v", "g", 20), "bin") == [("a", i, 3 * (i == 10)) for i in range(20)]
    density = profile.feature_density(df, "v", "g", 2).groupBy("g").agg(F.sum(F.col("density") * 0.5).alias("s"))
    assert [r["s"] for r in density.collect()] == pytest.approx([1, 1])


@pytest.mark.parametrize("limit", [0, 100])
def test_kde_matches_numpy(spark, monkeypatch, limit):
    from readgauge.operators import bounded
    monkeypatch.setattr(profile, "settled", lambda df: bounded.settled(df, limit))
    x = np.random.default_rng(1).integers(0, 30, 200).astype(float)
    df = spark.createDataFrame([("a", float(v)) for v in x], "g string, v double")
    h = len(x) ** -0.2 * x.std(ddof=1)
    for row in profile.feature_kde(df, "v", "g", 11).collect():
        at = x.min() + row["point"] * (x.max() - x.min()) / 10
        assert row["x"] == pytest.approx(at)
        assert row["density"] == pytest.approx(np.exp(-(((at - x) / h) ** 2) / 2).mean() / h / np.sqrt(2 * np.pi))


# Published confusion matrices of forests on such features, and their accuracies.
PUBLISHED = [
    ([[6718, 20, 1998], [42, 1087, 175], [2246, 104, 5082]], 0.7375801282051282),
    ([[1096, 48], [61, 1082]], 0.9523393091386095),
]


@pytest.mark.parametrize("matrix, accuracy", [*PUBLISHED, ([[5, 0], [0, 0]], 1.0), ([[4, 1, 0], [0, 3, 1], [1, 0, 0]], 0.7)])
def test_metrics_from_matrix(spark, matrix, accuracy):
    cells = [(i, j, n) for i, row in enumerate(matrix) for j, n in enumerate(row) if n]
    df = spark.createDataFrame(cells, "label int, prediction int, n int").select(
        "label", "prediction", F.explode(F.array_repeat(F.lit(1), F.col("n")))
    )
    assert metrics.accuracy(df).first()[0] == pytest.approx(accuracy)
    counted = {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    seen = {c for i, j, _ in cells for c in (i, j)}
    assert counted == {(i, j): matrix[i][j] for i in seen for j in seen}
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    for c in seen:
        tp, predicted, actual = matrix[c][c], sum(r[c] for r in matrix), sum(matrix[c])
        assert report[str(c)]["precision"] == pytest.approx(tp / predicted if predicted else 0)
        assert report[str(c)]["recall"] == pytest.approx(tp / actual if actual else 0)
        assert report[str(c)]["support"] == actual
    assert report["weighted avg"]["recall"] == pytest.approx(accuracy)


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    assert rows(metrics.class_weights(df), "label") == [("a", pytest.approx(4 / 6)), ("b", pytest.approx(2.0))]


def test_label_names_survive_encoding(spark):
    df = spark.createDataFrame([("RESULTS",), ("BACKGROUND",), ("METHODS",), ("METHODS",)], "role string")
    model = metrics.fit_label_encoder(df, "role")
    assert model.labels == ["BACKGROUND", "METHODS", "RESULTS"]
    back = metrics.decode_labels(model.transform(df), "label", model.labels, "name")
    assert all(r["name"] == r["role"] for r in back.collect())


def test_top_and_bottom(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3), ("d", 2)], "id string, v int")
    assert [r["id"] for r in metrics.top_k(df, "v", 2, "id").collect()] == ["b", "c"]
    assert [r["id"] for r in metrics.top_k(df, "v", 2, "id", largest=False).collect()] == ["a", "d"]


def test_role_ratios_for_texts_without_sentences(spark):
    sentences = spark.createDataFrame([("1", "x"), ("1", "x"), ("1", "y")], "doc string, role string")
    docs = spark.createDataFrame([("1",), ("2",)], "doc string")
    got = rows(roles.role_ratios(sentences, "doc", "role", ["x", "y", "z"], docs), "doc")
    assert got == [("1", pytest.approx(2 / 3), pytest.approx(1 / 3), 0.0), ("2", 0.0, 0.0, 0.0)]
    assert roles.corpus_role_ratio(sentences.limit(0), "role", "x").first()[0] == 0
    table = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "abstract_x_ratio double, summary_x_ratio double")
    assert roles.mean_role_ratio(table, ["x"]).first()["mean_ratio"] == pytest.approx(0.25)
