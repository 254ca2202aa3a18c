import pytest
from pyspark.sql import functions as F

from defectlens.operators import answers as A, ranking as R
from defectlens.plans.scoring import score_rows
from defectlens.functions import risk as K

SCHEMA = ("file string, function string, start_line int, end_line int, nloc int, ccn int, params int, length int, "
          "bug_probability double")


def scored(spark, probabilities, file="a.py"):
    rows = [(file, f"f{i:02}", i * 10 + 1, i * 10 + 5, 12, 7, 2, 15, p) for i, p in enumerate(probabilities)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n, bands", [(1, "H"), (2, "HM"), (3, "HML"), (5, "HMLLL"), (10, "HHMMMLLLLL")])
@pytest.mark.parametrize("bound", [1, 1000])
def test_bands(spark, n, bands, bound):
    rows = scored(spark, [1 - i / 100 for i in range(n)])
    got = R.risk_bands(rows, max_group_rows=bound).orderBy("rank").collect()
    assert "".join(r["risk_label"][0] for r in got) == bands
    assert [r["rank"] for r in got] == list(range(1, n + 1))
    assert all(r["functions_in_file"] == n for r in got)
    assert all(r["risk_total"] == bands.count(r["risk_label"][0]) for r in got)


def test_ties_keep_source_order_and_missing_probabilities_come_last(spark):
    rows = scored(spark, [0.5, None, 0.5, float("nan"), 0.9])
    got = R.risk_bands(rows).orderBy("rank").collect()
    assert [r["function"] for r in got] == ["f04", "f00", "f02", "f01", "f03"]


def test_rule_ranking(spark):
    rows = spark.createDataFrame([
        ("x.go", "low", 1, 2, 1, 1, 0, 1, None), ("x.go", "high", 3, 9, 20, 11, 4, 30, None),
        ("x.go", "medium", 10, 20, 10, 4, 2, 15, None), ("x.go", "blank", 21, 22, None, None, None, None, None),
    ], SCHEMA)
    got = score_rows(rows).orderBy("rank").collect()
    assert [(r["function"], r["display_score"]) for r in got] == [
        ("high", "#1 · High"), ("medium", "#2 · Medium"), ("low", "#3 · Low"), ("blank", "#4 · Low")]
    assert [r["risk_class"] for r in got] == ["risk-high", "risk-medium", "risk-low", "risk-low"]
    assert got[0]["fix_suggestion"] == f"Suggested fix: {K.TIP_BRANCHES} {K.TIP_SECTIONS}"
    assert got[0]["explanation"] == (
        "High complexity; Long function body; Many parameters; Large overall size")
    assert got[3]["fix_suggestion"] == f"Suggested fix: {K.TIP_DEFAULT}"
    assert got[3]["simple_explanation"] == f"In simpler terms, {K.PLAIN_DEFAULT}. {K.LOOKS_DEFAULT}"
    assert got[0]["simple_explanation"] == (
        "In simpler terms, the function has a lot of decision-making steps; the function is fairly long; "
        f"the function takes several inputs. {K.LOOKS['High']}")


def test_points(spark):
    rows = spark.createDataFrame(
        [(11, 20, 4, 30, 9), (4, 10, 2, 15, 4), (1, 1, 0, 1, 0), (None, None, None, None, 0)],
        "ccn int, nloc int, params int, length int, want int")
    for row in rows.withColumn("got", K.risk_score("ccn", "nloc", "params", "length")).collect():
        assert row["got"] == row["want"]


@pytest.fixture(scope="module")
def ranked(spark):
    rows = scored(spark, [1 - i / 100 for i in range(60)]).unionByName(scored(spark, [0.3], "one.py"))
    return score_rows_banded(rows).cache()


def score_rows_banded(rows):
    return R.explain(R.risk_bands(rows))


def test_heads_per_label(ranked):
    heads = R.functions_by_risk(ranked.where("file = 'a.py'"), "Medium", 10).orderBy("nth").collect()
    assert [(r["rank"], r["nth"], r["risk_total"]) for r in heads] == [(12 + i, i, 18) for i in range(1, 11)]
    assert R.top_functions(ranked, 5).count() == 6


def test_answers(spark, ranked):
    asked = spark.createDataFrame(
        [(1, "a.py", "show high risk"), (2, "one.py", "medium?"), (3, "a.py", "top"), (4, "gone.py", "why"),
         (5, "one.py", "why"), (6, "a.py", "hello"), (7, "a.py", "which features"), (8, None, "why")],
        "id int, file string, message string")
    got = {r["id"]: r for r in A.answer_questions(asked, ranked, ["nloc", "ccn"]).collect()}
    high = "I found 12 high-risk functions in your uploaded Python file:\n\n" + "".join(
        f"- #{i + 1} f{i:02} ({1 - i / 100:.3f})\n" for i in range(10))
    assert got[1]["answer"] == high
    assert got[2]["answer"] == "I didn't find any medium-risk functions in your uploaded Python file right now."
    assert got[3]["answer"].startswith("Here are the top 5 highest-ranked functions in your uploaded Python file:\n\n1. f00 (1.000, High)\n2.")
    assert got[3]["answer"].count("\n") == 7
    assert got[4]["answer"] == got[8]["answer"] == A.NO_UPLOAD
    assert got[5]["answer"].startswith("The highest-ranked function in your uploaded Python file is f00 in one.py.\n\nWhy it")
    assert got[6]["route"] == "free" and got[6]["answer"] is None
    assert "model features: nloc, ccn." in got[7]["answer"]
    salted = A.answer_questions(asked, ranked, ["nloc", "ccn"], max_group_rows=1)
    assert {r["id"]: r["answer"] for r in salted.collect()} == {i: r["answer"] for i, r in got.items()}


def test_upload_summary(spark, ranked):
    files = spark.createDataFrame([("one.py",), ("empty.js",)], "file string")
    got = {r["file"]: r["message"] for r in A.upload_summaries(files, ranked).collect()}
    assert got["empty.js"] == A.NO_FUNCTIONS
    assert got["one.py"].startswith("I analyzed one.py as a Python file and found 1 functions.\n\nTop result: #1 f00 (0.300, High).")


def test_prompts(spark, ranked):
    asked = spark.createDataFrame([(1, "a.py", "explain"), (2, "a.py", "why"), (3, "one.py", "explain")],
                                  "id int, file string, message string")
    files = spark.createDataFrame([("a.py", "é" * 30_000), ("one.py", "  ")], "path string, content string")
    rows = sorted(A.build_prompts(asked, ranked, files).collect(), key=lambda r: (r["id"], r["part"]))
    assert [(r["id"], r["part"], r["parts"], r["answer"]) for r in rows] == [(1, 1, 2, None), (1, 2, 2, None), (3, 1, 1, A.NO_CODE)]
    assert rows[2]["prompt"] is None and "```python\n" + "é" * 10_000 + "\n```" in rows[1]["prompt"]
    prompt = rows[0]["prompt"]
    assert "```python\n" + "é" * 20_000 + "\n```" in prompt
    assert "- #5 f04 | risk=High | ccn=7 | nloc=12 | params=2 | start=41 | end=45\n\nUser question:\nexplain" in prompt
    assert "#6" not in prompt


def test_final_order(spark, ranked):
    placed = R.final_order(ranked).where(F.col("position") != F.col("rank"))
    assert placed.count() == 0
