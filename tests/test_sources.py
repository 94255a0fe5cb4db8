import json
import os

import pytest
from pyspark.sql import functions as F

from readgauge.session import scratch_path
from readgauge.sources import articles, companion, labelled, results, tables

ARTICLES = [
    {"id": "elife-1", "abstract": ["First sentence.", "Second one."], "summary": ["Plain words."], "extra": 1},
    {"abstract": [], "summary": ["Only a summary.", "Two sentences."]},
    {"id": "x"},
]
EXPECTED = {
    "elife-1": ("First sentence. Second one.", "Plain words."),
    "doc_2": ("", "Only a summary. Two sentences."),
    "x": ("", ""),
}


def as_dict(df):
    return {r["doc_id"]: (r["abstract"], r["summary"]) for r in df.collect()}


def test_article_array(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(ARTICLES, indent=1))
    assert as_dict(articles.read_articles(spark, str(path), "array")) == EXPECTED


def test_article_array_too_large_to_number(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(ARTICLES))
    monkeypatch.setattr(articles, "ARRAY_FILE_LIMIT", 10)
    with pytest.raises(Exception, match="too large"):
        articles.read_articles(spark, str(path), "array").collect()
    path.write_text(json.dumps([a for a in ARTICLES if "id" in a]))
    assert set(as_dict(articles.read_articles(spark, str(path), "array_with_ids"))) == {"elife-1", "x"}


@pytest.mark.parametrize("text", ['[{"id": "a", "abstract": ["x"]}, {"id": "b", "abs', "plain garbage",
                                  '[{"id": "a", "abstract": "a string"}]'])
@pytest.mark.parametrize("layout", ["array", "array_with_ids", "lines"])
def test_malformed_articles_are_errors(spark, tmp_path, text, layout):
    path = tmp_path / "a.json"
    path.write_text(text[1:-1] if layout == "lines" and text[-1] == "]" else text)
    with pytest.raises(Exception):
        articles.read_articles(spark, str(path), layout).collect()


def test_blank_article_file(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(" \n")
    assert articles.read_articles(spark, str(path), "array").collect() == []


def test_equal_abstracts_without_an_id_stay_apart(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_bytes(b"\r\n\r\n".join([b"AIM\tSame.\r\nEND\tDone."] * 2) + b"\r\n")
    rows = labelled.read_labelled_groups(spark, str(tmp_path)).collect()
    assert len(rows) == 8 and len({r["abstract_id"] for r in rows}) == 4
    assert len({(r["abstract_id"], r["pos"]) for r in rows}) == 8
    assert labelled.line_ending_of(spark, str(tmp_path)) == "\r\n"


def test_article_lines_need_ids(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(json.dumps(a) for a in ARTICLES if "id" in a))
    assert as_dict(articles.read_articles(spark, str(path))) == {k: v for k, v in EXPECTED.items() if k != "doc_2"}
    path.write_text("\n".join(map(json.dumps, ARTICLES)))
    with pytest.raises(Exception, match="no id"):
        articles.read_articles(spark, str(path)).collect()
    with pytest.raises(ValueError):
        articles.read_articles(spark, str(path), "other")


def test_csv_pairs_with_hard_texts(spark, tmp_path):
    texts = [("1", 'He said "no", twice\nand left', " lead"), ("2", None, "back\\slash, \"q\""), ("3", "x", None)]
    df = spark.createDataFrame(texts, "doc_id string, abs_text string, pls_text string")
    tables.write_csv(df, str(tmp_path / "p"))
    got = as_dict(articles.read_pairs_csv(spark, str(tmp_path / "p")))
    assert got == {i: (a or "", s or "") for i, a, s in texts}
    with pytest.raises(ValueError, match="missing columns"):
        articles.read_pairs_csv(spark, str(tmp_path / "p"), summary_col="Eureka")


def test_empty_csv_keeps_header(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([], "doc_id string, x double"), str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).columns == ["doc_id", "x"]


def test_feature_csv(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([("a", 1.0), ("a", None)], "doc_id string, x double"), str(tmp_path / "f"))
    with pytest.warns(UserWarning, match="repeated"):
        df = tables.read_feature_csv(spark, str(tmp_path / "f"))
    assert df.dtypes == [("doc_id", "string"), ("x", "double")]
    with pytest.raises(ValueError, match="no column"):
        tables.read_feature_csv(spark, str(tmp_path / "f"), key="id")


GROUPS = "###1001\nBACKGROUND\tSentence one.\nMETHODS\tSentence two.\n\n###1002\nRESULTS\tSentence three.\na line without a tab\n\n\nOBJECTIVE\tNo id.\n"


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_labelled_groups(spark, tmp_path, ending):
    path = tmp_path / "g.txt"
    path.write_bytes(GROUPS.replace("\n", ending).encode())
    rows = labelled.read_labelled_groups(spark, str(path), ending).collect()
    got = sorted((r["abstract_id"][:4], r["pos"], r["label"], r["sentence"]) for r in rows)
    assert got[:3] == [("1001", 0, "BACKGROUND", "Sentence one."), ("1001", 1, "METHODS", "Sentence two."),
                       ("1002", 0, "RESULTS", "Sentence three.")]
    assert len(got) == 4 and got[3][1:] == (0, "OBJECTIVE", "No id.")


def test_labelled_flat_and_malformed(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text(GROUPS + "A\tb\tc\n")
    assert labelled.read_labelled_flat(spark, str(path)).count() == 4
    assert {r["line"] for r in labelled.read_labelled_rejects(spark, str(path)).collect()} == {"a line without a tab", "A\tb\tc"}
    with pytest.raises(Exception, match="malformed line"):
        labelled.read_labelled_groups(spark, str(path)).collect()
    assert labelled.read_labelled_groups(spark, str(path), on_malformed="drop").count() == 4


def test_companion_lookup_and_preparation(spark, tmp_path):
    root = tmp_path / "data" / "data"
    (root / "p").mkdir(parents=True)
    body = "x" * 101
    (root / "p" / "1.txt").write_text(f"Title\nThe Abstract here\n  {body}#@NEW_LINE#@#  \nrest")
    (root / "p" / "2.txt").write_text("no marker\nat all")
    (root / "p" / "3.txt").write_text("Title\nAbstract")
    (root / "p" / "4.txt").write_text("Abstract\n" + "y" * 100)
    table = spark.createDataFrame(
        [(i, "J", "plain", f"p/{i}.xml") for i in range(1, 6)],
        "id int, Paper_Journal string, Eureka_Text_Simplified string, Full_Paper_XML string",
    )
    files = companion.read_companions(spark, str(root))
    found = companion.lookup_companion(table, files, "Full_Paper_XML").select(
        "id", companion.line_after_marker(F.col("companion")).alias("a")
    )
    assert {r["id"]: r["a"] for r in found.collect()} == {1: body, 2: "", 3: "", 4: "y" * 100, 5: ""}
    ready = companion.prepare_dataset(table, files).collect()
    assert [(r["id"], r["Paper_abstract"]) for r in ready] == [(1, body)]


def test_length_filter_reaches_the_reader(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = companion.keep_longer_than(df.select("doc_id", "n_chars", "text"), "text", 100, "n_chars").select("doc_id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n_chars,100)" in plan and "text:string" not in plan


def test_results_round_trip(spark, tmp_path):
    record = (["a", "b"], [[3, 1], [0, 2]], [0.5, 0.5], None, None, 5 / 6, ["x", "y"], None)
    df = spark.createDataFrame([record], results.RESULT)
    results.write_results(df, str(tmp_path / "r"))
    assert results.read_results(spark, str(tmp_path / "r")).collect() == df.collect()


def test_scratch_is_below_the_checkpoint_folder(spark):
    a, b = scratch_path(spark, "t"), scratch_path(spark, "t")
    assert a != b and os.path.dirname(a) == spark.conf.get("spark.checkpoint.dir")
