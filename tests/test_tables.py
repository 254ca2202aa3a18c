import csv
import json
import random

import pytest

from defectlens.schemas import FUNCTION_METRICS, BASIC_METRICS
from defectlens.operators import labelling as D
from defectlens.sources import split_csv, tables


def test_typed_csv_by_name(spark, tmp_path):
    (tmp_path / "m.csv").write_text('ccn,function,nloc,extra\n3,"a ""q"", b",x\n4.0,c,7,y\n')
    rows = tables.read_table(spark, f"file://{tmp_path}/m.csv", FUNCTION_METRICS).orderBy("function").collect()
    assert [(r["function"], r["ccn"], r["nloc"], r["file"]) for r in rows] == [('a "q", b', 3, None, None), ("c", 4, 7, None)]


def test_absent(spark, tmp_path):
    path = f"file://{tmp_path}/none.csv"
    assert tables.read_optional(spark, path, FUNCTION_METRICS) is None
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, path, FUNCTION_METRICS)


def test_label_table_keeps_columns_and_labels(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "function,ccn,nloc,params,length,radon_grade,note\na,9,,,,,n1\nb,1,2,1,2,A,\nc,4,2,1,2,,\n")
    source, target = f"file://{tmp_path}/m.csv", f"file://{tmp_path}/out"
    tables.label_table(spark, source, target)
    rows = {r["function"]: r for r in tables.read_raw(spark, target).collect()}
    assert {k: r["bug_label"] for k, r in rows.items()} == {"a": "1", "b": "0", "c": ""}
    assert rows["a"]["note"] == "n1"
    tables.label_table(spark, source, f"{target}2", D.apply_threshold_label)
    rows = {r["function"]: r["bug_label"] for r in tables.read_raw(spark, f"{target}2").collect()}
    assert rows == {"a": "1", "b": "0", "c": "0"}
    with pytest.raises(ValueError):
        tables.label_table(spark, source, source + "/")
    with pytest.raises(ValueError, match="missing"):
        D.apply_threshold_label(spark.createDataFrame([(1,)], "ccn int"))


def test_existing_labels_stay(spark):
    df = spark.createDataFrame([("1", 1), (" 0 ", 9), ("x", 9), (None, 4)], "bug_label string, ccn int")
    df = df.selectExpr("*", "ccn AS nloc", "0 AS params", "1 AS length", "'' AS radon_grade")
    got = D.apply_rule_label(df)
    assert [r["bug_label"] for r in got.collect()] == ["1", " 0 ", "1", ""]
    assert tuple(D.label_counters(df).first()) == (1, 2, 1)
    blank_grade = D.apply_rule_label(df.withColumns({"bug_label": df.ccn.cast("string")}), grade="blank")
    assert blank_grade.where("bug_label = '0'").count() == 0


def test_json_writes_missing_as_null(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None)], "a int, b double, c string")
    tables.write_json(df, f"file://{tmp_path}/j")
    text = "".join(p.read_text() for p in (tmp_path / "j").iterdir() if p.suffix == ".json")
    assert text.strip() == '{"a":1,"b":null,"c":null}'


# Complexity histogram of the published metrics table.
HISTOGRAM = {1: 11, 2: 18, 3: 24, 4: 12, 5: 12, 6: 10, 7: 3, 8: 6, 11: 2, 12: 1}


def test_published_metrics_table(spark):
    rows = [("repos", f"f{c}_{i}", "1", "", "", str(c), "", "", "", "", str(c), "") for c, n in HISTOGRAM.items() for i in range(n)]
    df = spark.createDataFrame(rows, BASIC_METRICS)
    rule = {r["bug_label"]: r["n"] for r in D.value_counts(D.apply_rule_label(df), "bug_label").collect()}
    assert rule == {"0": 29, "1": 9, "": 61}
    threshold = {r["bug_label"]: r["n"] for r in D.value_counts(D.apply_threshold_label(df), "bug_label").collect()}
    assert threshold == {1: 22, 0: 77}


def test_split_csv_equals_one_task_at_any_block_border(spark, tmp_path):
    draw = random.Random(9)
    values = ["plain", "", 'a "q" b', "two\nlines", "three\n\n\nlines", ",", '"', '"\n"', "x" * 300 + "\n" + "y" * 300, "é\n", "end\n", " "]
    rows = [[str(i), draw.choice(values), draw.choice(values)] for i in range(150)]
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, "w", newline="") as file:
            writer = csv.writer(file, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
            writer.writerow(["id", "left", "right, \"too\""])
            writer.writerows(rows)
    path = f"file://{tmp_path}/*.csv"
    want = sorted(map(tuple, tables.read_raw(spark, path).collect()))
    assert sorted(want) == sorted([tuple(r) for r in rows] * 2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in (61, 500, 5000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = tables.read_raw(spark, path, block_bytes=1)
            assert got.columns == ["id", "left", 'right, "too"'] and sorted(map(tuple, got.collect())) == want
        assert split_csv._lines(spark, path).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_relabel_in_place(spark, tmp_path):
    (tmp_path / "m.csv").write_text("function,ccn,nloc,params,length,radon_grade,bug_label\na,9,,,,,\nb,1,2,1,2,A,\n")
    path = f"file://{tmp_path}/m.csv"
    tables.relabel_table(spark, path)
    labels = lambda: {r["function"]: r["bug_label"] for r in tables.read_raw(spark, path).collect()}
    assert labels() == {"a": "1", "b": "0"} and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["m.csv"]

    def fails(df):
        raise RuntimeError("no labels")

    with pytest.raises(RuntimeError):
        tables.relabel_table(spark, path, fails)
    assert labels() == {"a": "1", "b": "0"}
    (tmp_path / "m.csv").rename(tmp_path / "m.csv._old")  # as if broken off between the renames
    tables.relabel_table(spark, path)
    assert labels() == {"a": "1", "b": "0"} and not (tmp_path / "m.csv._old").exists()


@pytest.mark.parametrize("n", [0, 1, 500])
def test_wrapped_json_parts_make_one_document(spark, tmp_path, n):
    df = spark.range(n).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'x\"y' END AS s", "CASE WHEN id % 3 = 0 THEN double('nan') ELSE id / 2 END AS p").repartition(7)
    tables.write_wrapped_json(df, f"file://{tmp_path}/doc", ["nloc", "ccn"])
    parts = sorted(p for p in (tmp_path / "doc").rglob("part-*") if p.suffix == ".txt")
    document = json.loads("".join(p.read_text() for p in parts))
    assert (document["features"], document["num_rows"], len(document["predictions"])) == (["nloc", "ccn"], n, n)
    assert sorted(r["id"] for r in document["predictions"]) == list(range(n))
    assert all(r["s"] == ('x"y' if r["id"] % 2 == 0 else None) and r["p"] == (None if r["id"] % 3 == 0 else r["id"] / 2) for r in document["predictions"])
