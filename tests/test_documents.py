"""Uploaded files, report documents, flat files, stored ranges and result folders."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from msgscope.operators import documents as DOC
from msgscope.sources import uploads as UP


# ------------------------------------------------------------------ BAT-04
@pytest.fixture
def folder(tmp_path):
    base = tmp_path / "in"
    (base / "deep").mkdir(parents=True)
    files = {
        "ok.txt": "Grüße – ok".encode(), "latin.txt": "Grüße".encode("latin-1"), "empty.txt": b"", "deep/none + ü %20.txt": b"", "full + ü %20.txt": b"x", "blank.txt": b" \n\t\xc2\xa0",
        "long.txt": b"a" * 10_001, "edge.txt": "ü".encode() * 10_000, "large.txt": b"b" * (100 * 1024 + 1),
        "large_bad.txt": b"\xff" * (100 * 1024 + 1), "deep/nested.txt": b"nested\nlines", "cut.txt": "ü".encode()[:1], "surrogate.txt": b"\xed\xa0\x80",
    }
    for name, content in files.items():
        (base / name).write_bytes(content)
    return base, files


def plain_reason(content):
    """The checks, one after the other, in Python."""
    if len(content) > UP.MAX_FILE_BYTES:
        return UP.TOO_LARGE
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return UP.NOT_UTF8
    return UP.EMPTY if not text.strip() else UP.TOO_LONG if len(text) > UP.MAX_TEXT_CHARS else None


def test_files_judged_as_by_plain_checks(spark, folder):
    base, files = folder
    got = {r["path"].split("/in/")[1]: r for r in UP.judged(UP.read_files(spark, str(base))).collect()}
    assert set(got) == set(files)
    for name, content in files.items():
        assert got[name]["reason"] == plain_reason(content), name
        assert got[name]["n_bytes"] == len(content)
        assert got[name]["text"] == (content.decode() if plain_reason(content) is None else None)


def test_large_contents_are_not_read(spark, folder):
    base, _ = folder
    read = UP.read_files(spark, str(base))
    assert read.where("n_bytes > 102400 AND content IS NOT NULL").count() == 0
    assert "LessThanOrEqual(length,102400)" in read._jdf.queryExecution().toString()


def test_ingest_parts_both_tables(spark, folder, tmp_path):
    base, files = folder
    out = str(tmp_path / "out")
    UP.ingest(UP.read_files(spark, str(base)), out)
    want = {n for n, c in files.items() if plain_reason(c) is None}
    assert {r["path"].split("/in/")[1] for r in UP.accepted(spark, out).collect()} == want
    gone = {r["path"].split("/in/")[1]: r["reason"] for r in UP.rejected(spark, out).collect()}
    assert gone == {n: plain_reason(c) for n, c in files.items() if n not in want}


def test_files_of_a_table_nulls_and_repeats(spark):
    rows = [("a", None, None), ("a", 2, bytearray(b"hi")), ("a", 2, bytearray(b"hi")), (None, None, bytearray(b"x")), ("b", None, bytearray(b"\xff"))]
    files = spark.createDataFrame(rows, "path string, n_bytes long, content binary").withColumn("reason", F.lit(1))
    got = sorted(((r["path"], r["text"], r["reason"]) for r in UP.judged(files).collect()), key=str)
    assert got == sorted([("a", None, UP.EMPTY), ("a", "hi", None), ("a", "hi", None), (None, "x", None), ("b", None, UP.NOT_UTF8)], key=str)
    assert UP.judged(files.limit(0)).count() == 0


# ------------------------------------------------------------------ documents
def test_json_document_round_trip_and_order(spark, tmp_path):
    table = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", None), ("d", 9.0)], "name string, x double")
    doc = DOC.document(
        DOC.as_list(table, "all", [F.col("x").desc_nulls_last(), F.col("name")]), DOC.as_list(table, "top", [F.col("name")], top=2),
        DOC.as_map(table.where("x IS NOT NULL"), "map", "name", "x"),
    )
    path = str(tmp_path / "doc")
    DOC.write_json(doc, path)
    read = DOC.read_json(spark, path, "all array<struct<name:string,x:double>>, top array<struct<name:string,x:double>>, map map<string,double>").first()
    assert [tuple(e) for e in read["all"]] == [("d", 9.0), ("a", 2.0), ("b", 2.0), ("c", None)]
    assert [e["name"] for e in read["top"]] == ["a", "b"] and read["map"] == {"a": 2.0, "b": 2.0, "d": 9.0}
    text = "".join(p.read_text() for p in (tmp_path / "doc").glob("part-*"))
    assert json.loads(text)["all"][3] == {"name": "c", "x": None}


def test_document_of_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "name string, x double")
    path = str(tmp_path / "doc")
    DOC.write_json(DOC.document(DOC.as_list(empty, "all", [F.col("name")]), DOC.as_map(empty, "map", "name", "x")), path)
    assert DOC.read_json(spark, path, "all array<struct<name:string,x:double>>, map map<string,double>").first().asDict() == {"all": [], "map": {}}


def test_broken_document_is_an_error(spark, tmp_path):
    (tmp_path / "doc.json").write_text('{"n": 1')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        DOC.read_json(spark, str(tmp_path / "doc.json"), "n long").collect()


def test_lines_keep_their_order(spark, tmp_path):
    lines = ["first", "", "  indented", "z", "a", ""]
    path = str(tmp_path / "report")
    DOC.write_lines(spark.createDataFrame([(lines,)], "lines array<string>"), path)
    assert [r["line"] for r in DOC.read_lines(spark, path).orderBy("line_no").collect()] == lines


def test_csv_round_trip(spark, tmp_path):
    rows = [('say "hi", then\nleave', 1, "a"), ("  outer  ", 0, "b"), ("\\ back\\", 0, None), ("", 1, "c"), ("cr\r\nlf\rx", 0, "d"), ("ü–😀", None, "e"), ("same", 1, "s"), ("same", 1, "s")]
    path = str(tmp_path / "t.csv")
    DOC.write_csv(DOC.combined(spark.createDataFrame(rows, "text string, label int, source string").withColumn("more", F.lit(1))), path)
    got = DOC.read_csv(spark, path, "text string, label int, source string")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)


def test_csv_maps_as_json(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    DOC.write_csv(spark.createDataFrame([(0, {"a": 3, 'q"': 1})], "k int, m map<string,long>"), path)
    assert json.loads(DOC.read_csv(spark, path, "k int, m string").first()["m"]) == {"a": 3, 'q"': 1}


# ------------------------------------------------------------------ ranges, chart, rates, histogram
def test_stored_ranges(spark, tmp_path):
    points = spark.createDataFrame([(0, 0.0, 5.0), (1, 10.0, 5.0)], "i int, px double, py double")
    path = str(tmp_path / "r")
    DOC.write_ranges(points, "px", "py", path)
    new = spark.createDataFrame([(0, -1.0, 5.0), (1, 2.5, 7.0), (2, 99.0, None)], "i int, px double, py double")
    got = {r["i"]: (r["x_scaled"], r["y_scaled"]) for r in DOC.scale_by(new, DOC.read_ranges(spark, path), "px", "py").collect()}
    assert got == {0: (0.0, 50.0), 1: (25.0, 50.0), 2: (100.0, None)}
    DOC.write_ranges(points.limit(0), "px", "py", path)
    assert {r["x_scaled"] for r in DOC.scale_by(new, DOC.read_ranges(spark, path), "px", "py").collect()} == {50.0}


def test_chart_takes_the_document_order(spark):
    bars = [(f"f{i:02d}", "B" if i % 2 else "A", float(40 - i)) for i in range(40)]
    doc = spark.createDataFrame([(bars, bars[::-1])], "feature_comparison array<struct<feature:string,feature_group:string,ratio:double>>, top_discriminative array<struct<feature:string,feature_group:string,ratio:double>>")
    assert [r["feature"] for r in DOC.chart(doc, "B").orderBy("rank").collect()] == [b[0] for b in bars if b[1] == "B"][:15]
    assert [r["feature"] for r in DOC.chart(doc).orderBy("rank").collect()] == [b[0] for b in bars[::-1]][:15]
    assert DOC.chart(doc, "none").count() == 0


def test_display_rates(spark):
    counts = spark.createDataFrame([("a", 1, 1, 7, 191), ("b", 0, 0, 0, 0), ("c", 5, 0, 0, 0)], "source string, tp long, fp long, fn long, tn long")
    got = {r["source"]: tuple(r)[1:] for r in DOC.display_rates(counts, ["source"]).collect()}
    assert got == {"a": (96, 13, 99), "b": (0, 0, 0), "c": (100, 100, 0)}  # 12.5 goes up; no ham: no rate


def test_histogram_as_numpy(spark):
    import numpy as np

    values = [-0.5, -0.5, 0.0, 0.1, 0.25, 0.7, 0.7]
    got = DOC.value_histogram(spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double"), "x", 6).orderBy("bin").collect()
    n, ends = np.histogram(values, bins=6)
    assert [r["n"] for r in got] == n.tolist() and np.allclose([r["low"] for r in got] + [got[-1]["high"]], ends)
    one = DOC.value_histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", 4).orderBy("bin").collect()
    n, ends = np.histogram([2.0, 2.0], bins=4)
    assert [r["n"] for r in one] == n.tolist() and one[0]["low"] == ends[0]
    assert DOC.value_histogram(spark.createDataFrame([], "x double"), "x").count() == 0


# ------------------------------------------------------------------ SRC-12, JN-08
def test_result_folder_with_gaps(spark, tmp_path):
    base = tmp_path / "results"
    doc = {
        "clustering_performance": {"silhouette_score": {"train": 0.25, "test": 0.5}}, "classification_performance": {"accuracy": 0.75, "f1_score": 0.5}, "other": [1],
    }
    for k, config, text in ((2, "current", json.dumps(doc, indent=2)), (3, "current", '{"broken": '), (2, "source_0.10", json.dumps(doc))):
        at = base / f"k={k}" / f"config={config}"
        at.mkdir(parents=True)
        (at / "clustering_results.json").write_text(text)
    asked = spark.createDataFrame([(k, c) for k in (2, 3, 4) for c in ("current", "source_0.10", "tfidf_50")] + [(2, "current")], "k int, config string")
    got = {(r["k"], r["config"]): r for r in DOC.aligned(DOC.read_results(spark, str(base)), asked).collect()}
    assert len(got) == 9
    assert {p: r["status"] for p, r in got.items() if r["status"] != "missing"} == {(2, "current"): "loaded", (2, "source_0.10"): "loaded", (3, "current"): "unreadable"}
    hit = got[(2, "current")]
    assert (hit["silhouette_score_train"], hit["silhouette_score_test"], hit["accuracy"], hit["f1_score"], hit["roc_auc"]) == (0.25, 0.5, 0.75, 0.5, None)
    assert got[(3, "current")]["accuracy"] is None and got[(4, "current")]["accuracy"] is None


def test_result_folder_written_and_absent(spark, tmp_path):
    rows = spark.createDataFrame([(2, "a b/c", (0.5,)), (4, "1", (0.25,))], "k int, config string, classification_performance struct<accuracy:double>")
    DOC.write_results(rows, str(tmp_path / "r"))
    got = {(r["k"], r["config"]): r["classification_performance"]["accuracy"] for r in DOC.read_results(spark, str(tmp_path / "r")).collect()}
    assert got == {(2, "a b/c"): 0.5, (4, "1"): 0.25}
    nothing = DOC.aligned(DOC.read_results(spark, str(tmp_path / "none")), rows.select("k", "config")).collect()
    assert [r["status"] for r in nothing] == ["missing", "missing"]
    with pytest.raises(PySparkException):
        DOC.write_results(rows.unionByName(rows), str(tmp_path / "twice"))
