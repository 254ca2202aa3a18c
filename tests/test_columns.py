import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from defectlens.functions import commits as C, numbers as N, paths as P, questions as Q
from defectlens.functions.labels import rule_label, threshold_label


@pytest.mark.parametrize("raw, expected", [
    ("a//b", "a/b"), ("a\\b\\", "a/b"), ("./a/./b", "a/b"), ("a/././b/.", "a/b"), ("a/..b", "a/..b"), ("/", "/"), ("", ""),
    (".hid/c.py", ".hid/c.py"),
])
def test_norm_path(values, raw, expected):
    assert values([raw], P.norm_path("c")) == [expected]


def test_extension_and_support(values):
    paths = ["src/{a.py => b.py}", "{old => new}/x.py", "a/b.PY", ".gitignore", "a/x.", "a.b/c", "x.tar.mm"]
    assert values(paths, P.extension("c")) == [".py}", ".py", ".py", "", "", "", ".mm"]
    assert values(paths, P.is_supported("c")) == [False, True, True, False, False, False, True]
    assert values(paths, P.language("c")) == ["Unknown", "Python", "Python", "Unknown", "Unknown", "Unknown", "Objective-C++"]


def test_repo_name(values):
    paths = ["data/repos/r1/a.py", "x/y.py", "data/repos", "", "/abs/x.py", "repos/r2", "a/repos/r3/repos/r4/b.c"]
    assert values(paths, P.repo_name("c")) == ["r1", "x", "data", "", "/", "r2", "r3"]


def test_is_test_file(values):
    paths = ["latest.py", "inspector.py", "a/tests/b.py", "a/b.py", "a/__tests__/b.js", "a/Spec/b.py", "test/b.py"]
    assert values(paths, P.is_test_file("c")) == [1, 1, 1, 0, 1, 0, 0]


def test_function_names(values):
    names = [None, "", " (anonymous) ", "anonymous", " go "]
    assert values(names, P.clean_function_name("c")) == ["anonymous closure"] * 4 + ["go"]
    assert values(names, P.clean_function_name("c", "extract"))[:2] == ["anonymous_closure"] * 2


def test_number_text(values):
    assert values(["-", "", " 7 ", "x", None], N.numstat_int("c")) == [0, 0, 7, 0, 0]
    assert values(["5.9", "", "nan", "inf", "-5.9", "1d", "x"], N.to_int_trunc("c")) == [5, None, None, None, -5, None, None]
    assert values(["1e3", ".5", "1f", "0x10", " 2 "], N.to_number("c")) == [1000.0, 0.5, None, None, 2.0]


def test_line_span(spark):
    rows = spark.createDataFrame([(3, 7), (0, 7), (3, 0)], "s int, e int")
    assert [r[0] for r in rows.select(N.line_span("s", "e")).collect()] == [5, 0, 0]


def test_rounding_agrees_with_python(values):
    ratios = [k / n for n in random.Random(7).sample(range(1, 1200), 60) for k in range(n + 1)] + [1 / 128, 1 / 640]
    assert values(ratios, N.py_round("c"), "double") == [round(x, 6) for x in ratios]
    assert values([0.0625, None, 0.9996], N.probability_text("c"), "double") == ["0.062", "—", "1.000"]


def test_grades(values):
    assert values([1, 5, 6, 10, 11, 20, 21, 30, 31, 40, 41, None], N.complexity_grade("c"), "int") == [
        "A", "A", "B", "B", "C", "C", "D", "D", "E", "E", "F", None]


def test_commit_dates(values):
    text = ["2024-01-01T05:00:00+02:00", "2024-01-01T05:00:00Z", "bad", "", "2024"]
    micros = F.unix_micros(C.commit_ts("c"))
    at = lambda hour: dt.datetime(2024, 1, 1, hour, tzinfo=dt.timezone.utc).timestamp() * 1e6
    assert values(text, micros) == [at(3), at(5), None, None, None]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_late_night_and_weekend_are_utc(spark, values, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        text = ["2026-03-01T05:59:59Z", "2026-03-01T06:00:00Z", "2026-02-27T23:59:59Z", "1969-12-27T00:00:00Z"]
        assert values(text, C.late_night(C.commit_ts("c"))) == [True, False, False, True]
        assert values(text, C.weekend(C.commit_ts("c"))) == [True, True, False, True]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_bugfix_words(values):
    subjects = ["a FIX!", "Prefix", "bug_fix", "éfix", "hotfix: x", "correcting", None]
    assert values(subjects, C.is_bugfix("c")) == [True, False, False, False, True, False, False]


def test_rule_label(spark):
    rows = [
        # ccn, grade, nloc, params, length, label
        (None, "d", None, None, None, 1), (8, "A", None, None, None, 1), (1, " c ", None, None, None, 1),
        (6, "B", 10, 0, 0, 1), (6, "B", 9, 0, 0, None), (5, "A", 0, 4, 0, 1), (5, "A", 0, 0, 30, 1),
        (2, "A", 8, 2, 99, 0), (2, "A", None, None, None, 0), (2, "A", 9, 2, 0, None), (3, "B", 6, 2, 0, 0),
        (3, "A", 1, 1, 1, None), (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, ccn int, grade string, nloc int, params int, length int, want int")
    for row in df.withColumn("got", rule_label("ccn", "grade", "nloc", "params", "length")).collect():
        assert row["got"] == row["want"], row


def test_threshold_label(spark):
    rows = [(None, None, None, None, 0), (6, None, None, None, 1), (None, 20, 1, 1, 1), (5, 19, 3, 29, 0), (0, 0, 4, 0, 1)]
    df = spark.createDataFrame(rows, "ccn int, nloc int, params int, length int, want int")
    for row in df.withColumn("got", threshold_label("ccn", "nloc", "params", "length")).collect():
        assert row["got"] == row["want"], row


def test_question_routes(values):
    messages = ["Why? top", "top high-risk", "how to fix", "Most complex", " MEDIUM ", "features", "x", "high risk"]
    assert values(messages, Q.route_question("c", F.lit(True))) == [
        "why", "high", "free", "top", "medium", "metrics", "free", "high"]
    assert values(["why"], Q.route_question("c", F.lit(False))) == ["upload"]


def test_error_classes(values):
    messages = ["Rate Limit", "429", "404 api key", "bad API KEY", "403", "boom"]
    assert values(messages, Q.classify_error("c")) == ["rate_limit", "rate_limit", "bad_model", "auth", "auth", "other"]
