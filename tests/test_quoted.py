"""Quoted CSV in small blocks against Python's reader."""

import csv
import io
import random

import pytest

from readgauge.sources import quoted


def table(rng, rows):
    cell = lambda: "".join(rng.choice(['a', 'é', ' ', ',', '"', '\n', '\r\n', 'word ', '""', "\n\n"]) for _ in range(rng.randint(0, 14)))
    return [[str(i), "x" + cell(), "y" + cell() + "."] for i in range(rows)]


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows(rows)
    return out.getvalue()


@pytest.fixture
def blocks(spark, request):
    """Blocks of so many bytes, so that records go over several."""
    keys = {"spark.sql.files.maxPartitionBytes": f"{request.param}b", "spark.sql.files.openCostInBytes": "0",
            "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("blocks", [23, 100, 1 << 20], indirect=True)
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_blocks_of_any_size(spark, tmp_path, blocks, end):
    rng = random.Random(blocks)
    want = []
    for name, n in (("a", 60), ("b", 1), ("c", 0)):
        rows = table(rng, n)
        want += rows
        (tmp_path / f"{name}.csv").write_text(written([["id", "first col", "z"], *rows], end), newline="")
    df = quoted.read_quoted_csv(spark, str(tmp_path))
    assert df.columns == ["id", "first col", "z"]
    assert sorted(map(list, df.collect())) == sorted(want)
    if blocks == 23:
        assert quoted.quoted_records(spark, str(tmp_path)).select("block").distinct().count() > 30


@pytest.mark.parametrize("blocks", [40], indirect=True)
def test_a_record_longer_than_many_blocks(spark, tmp_path, blocks):
    text = "line one\n" * 40 + 'a "quoted" word,\n' * 20
    rows = [["1", "short"], ["2", text], ["3", "last"]]
    (tmp_path / "a.csv").write_text(written([["k", "v"], *rows]), newline="")
    assert sorted(map(list, quoted.read_quoted_csv(spark, str(tmp_path)).collect())) == rows


def test_nulls_blanks_and_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,\n\n2,""\n3,"open\n', newline="")
    got = {r["k"]: r["v"] for r in quoted.read_quoted_csv(spark, str(tmp_path)).collect()}
    assert got["1"] is None and got["2"] is None and "3" in got and len(got) == 3  # as Spark's own reader has it
    (tmp_path / "b.csv").write_text("other,v\n1,2\n", newline="")
    with pytest.raises(ValueError):
        quoted.read_quoted_csv(spark, str(tmp_path))


def test_pieces_by_kind():
    lines = [("h", "f", 0, False), ('1,"a', "f", 0, False), ('b', "f", 10, True), ('c",x', "f", 20, True), ('2,y', "f", 20, True), ('3,"z', "g", 0, False)]
    assert list(quoted.put_together(iter(lines))) == [
        ("f", 0, 0, "record", "h"), ("f", 0, 1, "open", '1,"a'), ("f", 10, 0, "through", "b"), ("f", 20, 0, "tail", 'c",x'),
        ("f", 20, 1, "record", "2,y"), ("g", 0, 0, "open", '3,"z')]
