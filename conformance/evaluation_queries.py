"""Evaluation of scored functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from conformance.adapters import r6, scored, with_views
from conformance.registry import query
from defectlens.functions.numbers import py_round
from defectlens.operators import evaluate as V

THRESHOLD = 0.4
_CONFUSION = f"""
  SELECT count(*) FILTER (WHERE actual = 0 AND score < {THRESHOLD}) AS tn,
         count(*) FILTER (WHERE actual = 0 AND score >= {THRESHOLD}) AS fp,
         count(*) FILTER (WHERE actual = 1 AND score < {THRESHOLD}) AS fn,
         count(*) FILTER (WHERE actual = 1 AND score >= {THRESHOLD}) AS tp FROM usable"""


def _rounded(df, *names):
    return df.withColumns({n: py_round(n) for n in names})


@query("f9_confusion", with_views(["usable"], _CONFUSION))
def f9(spark, sf_dir):
    return V.confusion(scored(spark, sf_dir), THRESHOLD)


@query("f10_classification_metrics", with_views(["usable"], f"""
  SELECT tn, fp, fn, tp, CAST({THRESHOLD} AS DOUBLE) AS threshold, {r6("tp / (tp + fp)")} AS precision,
         {r6("tp / (tp + fn)")} AS recall, {r6("2 * tp / (2 * tp + fp + fn)")} AS f1_score,
         {r6("(tp + tn) / (tp + fp + fn + tn)")} AS accuracy FROM ({_CONFUSION})"""))
def f10(spark, sf_dir):
    metrics = V.classification_metrics(scored(spark, sf_dir), THRESHOLD)
    return _rounded(metrics, "precision", "recall", "f1_score", "accuracy")


_CLASSES = f"""
  SELECT '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fp + fn) AS f, tn + fp AS s FROM ({_CONFUSION})
  UNION ALL
  SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM ({_CONFUSION})"""


@query("f10_classification_report", with_views(["usable"], f"""
  SELECT class, {r6("p")} AS precision, {r6("r")} AS recall, {r6("f")} AS f1_score, CAST(s AS BIGINT) AS support FROM (
    SELECT * FROM ({_CLASSES})
    UNION ALL SELECT 'accuracy', a, a, a, s FROM (SELECT (tp + tn) / (tp + tn + fp + fn) AS a, tp + tn + fp + fn AS s FROM ({_CONFUSION}))
    UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM ({_CLASSES})
    UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), sum(s) FROM ({_CLASSES}))"""))
def f10_report(spark, sf_dir):
    report = V.classification_report(scored(spark, sf_dir), THRESHOLD)
    return _rounded(report, "precision", "recall", "f1_score")


_ROC = f"""
  SELECT score AS threshold, {r6("fp / n")} AS fpr, {r6("tp / p")} AS tpr FROM curve
  UNION ALL SELECT -1, 0, 0"""


def _roc(df):
    return _rounded(df, "fpr", "tpr").withColumn("threshold", F.coalesce("threshold", F.lit(-1.0)))


@query("g5_roc_curve", with_views(["curve"], _ROC))
def g5(spark, sf_dir):
    return _roc(V.roc_curve(scored(spark, sf_dir)))


@query("g5_roc_curve_sliced", with_views(["curve"], _ROC))
def g5_sliced(spark, sf_dir):
    """The plan for too many distinct scores for one task, forced by a small bound."""
    return _roc(V.roc_curve(scored(spark, sf_dir), max_group_rows=100))


@query("g5_roc_curve_corners", with_views(["curve"], f"""
  SELECT threshold, fpr, tpr FROM (
    SELECT score AS threshold, {r6("fp / n")} AS fpr, {r6("tp / p")} AS tpr, seen, pos, neg,
           lead(pos) OVER (ORDER BY score DESC) AS next_pos, lead(neg) OVER (ORDER BY score DESC) AS next_neg FROM curve)
  WHERE seen = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
  UNION ALL SELECT -1, 0, 0"""))
def g5_corners(spark, sf_dir):
    return _roc(V.roc_curve(scored(spark, sf_dir), drop_intermediate=True))


@query("g6_roc_auc", with_views(["curve"], f"""
  SELECT {r6("sum(pos * (2 * (n - fp) + neg)) / (2.0 * any_value(p) * any_value(n))")} AS roc_auc FROM curve"""))
def g6(spark, sf_dir):
    return _rounded(V.roc_auc(scored(spark, sf_dir)), "roc_auc")


_CANDIDATES = """
  SELECT score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM (SELECT score, pos, neg FROM counts UNION ALL SELECT 0.5, 0, 0)
        GROUP BY score) WINDOW w AS (ORDER BY score DESC)"""
_QUALITY = f"""
  SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, tp / p AS recall,
         2 * tp / (2 * tp + fp + p - tp) AS f1_score, (tp + n - fp) / (p + n) AS accuracy FROM ({_CANDIDATES})"""


@query("g7_pr_curve", with_views(["counts"], f"""
  SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(p AS BIGINT) AS tp_total,
         CAST(n AS BIGINT) AS fp_total, {r6("precision")} AS precision, {r6("recall")} AS recall,
         {r6("f1_score")} AS f1_score, {r6("accuracy")} AS accuracy FROM ({_QUALITY})"""))
def g7(spark, sf_dir):
    curve = V.pr_curve(scored(spark, sf_dir)).drop("pos", "neg")
    return _rounded(curve, "precision", "recall", "f1_score", "accuracy")


@query("g8_best_threshold", with_views(["counts"], f"""
  SELECT threshold, {r6("precision")} AS precision, {r6("recall")} AS recall, {r6("f1_score")} AS f1_score,
         {r6("accuracy")} AS accuracy, 'best_f1_with_min_precision_0.05' AS selection_rule
  FROM (SELECT *, CASE WHEN precision >= 0.05 THEN f1_score + 0.001::DOUBLE * recall
                       ELSE precision + 0.0001::DOUBLE * recall END AS objective FROM ({_QUALITY}))
  ORDER BY objective DESC, threshold LIMIT 1"""))
def g8(spark, sf_dir):
    best = V.best_threshold(scored(spark, sf_dir))
    return _rounded(best, "precision", "recall", "f1_score", "accuracy")


@query("f10_evaluate_scores", with_views(["curve"], f"""
  SELECT CAST({THRESHOLD} AS DOUBLE) AS threshold, tn, fp, fn, tp, {r6("tp / (tp + fp)")} AS precision,
         {r6("tp / (tp + fn)")} AS recall, {r6("2 * tp / (2 * tp + fp + fn)")} AS f1_score,
         {r6("(tp + tn) / (tp + fp + fn + tn)")} AS accuracy, roc_auc, 'given' AS selection_rule
  FROM ({_CONFUSION}) CROSS JOIN (
    SELECT {r6("sum(pos * (2 * (n - fp) + neg)) / (2.0 * any_value(p) * any_value(n))")} AS roc_auc FROM curve)"""))
def f10_all(spark, sf_dir):
    row = V.evaluate_scores(scored(spark, sf_dir), THRESHOLD)
    return _rounded(row, "precision", "recall", "f1_score", "accuracy", "roc_auc")
