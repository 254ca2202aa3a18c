from pyspark.sql import functions as F

from defectlens.llm import linededup
from helpers import line_dedup

SCHEMA = "doc_id long, text string, kept string, id string, _id string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA)


def check(spark, rows, min_docs=10):
    got = linededup.dedup_lines(frame(spark, rows), min_docs=min_docs).collect()
    assert sorted(((r["doc_id"], r["kept"], r["n_lines"], r["n_dropped"]) for r in got), key=str) == sorted(
        ((i, *want) for (i, _), want in zip(rows, line_dedup(rows, min_docs))), key=str)


def test_equals_plain_python(spark):
    hot = " Common LINE\t"
    rows = [(i, f"own {i}\n{hot if i % 2 else 'common line'}\nÉtat\n\nown {i}") for i in range(12)]
    rows += [(20 + i, text) for i, text in enumerate([None, "", "\n", "\n\n", "common line", "common line\ncommon line", "état", "no newline"])]
    rows += [(40, "x\n" * 3000 + "Common line"), (41, "\x0bcommon line\x0c\r"), (42, " common line")]
    check(spark, rows)
    check(spark, rows, min_docs=2)


def test_ids_may_repeat_or_be_null(spark):
    rows = [(1, "same\nline")] * 15 + [(None, "gone\nstays")] * 3 + [(i, "gone") for i in range(2, 11)] + [(2, "another text")]
    check(spark, rows)


def test_empty_table_and_columns(spark):
    assert linededup.dedup_lines(frame(spark, [])).count() == 0
    rows = [(i, "a\nb") for i in range(10)] + [(11, None)]
    out = linededup.without_repeated_lines(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    assert {r["text"] for r in out.collect()} == {"", None}
    assert out.where(F.col("kept") != "x").count() == 0
