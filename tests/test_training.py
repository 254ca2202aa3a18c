import numpy as np
import pytest
from pyspark.sql import functions as F

from conformance.adapters import functions
from defectlens.functions.numbers import coerce_numeric
from defectlens.operators import features as E, split as S
from defectlens.plans import scoring, training as T
from defectlens.schemas import COMBINED_FEATURES, PREDICTION_COLUMNS, STATIC_FEATURES

SF = "/root/testdata/sf0.001"
SMALL = T.ForestSettings(trees=10, depth=4)


@pytest.fixture(scope="module")
def table(spark):
    return functions(spark, SF).cache()


@pytest.mark.parametrize("groups, sizes", [(9, (6, 1, 2)), (4, (2, 1, 1)), (10, (7, 1, 2)), (100, (70, 15, 15))])
def test_group_split_sizes(groups, sizes):
    assert S.group_split_sizes(groups) == sizes


def test_too_few_groups(spark):
    with pytest.raises(ValueError):
        S.group_split_sizes(3)


@pytest.mark.parametrize("small", [3, 50_000])
def test_groups_do_not_straddle(table, small):
    split = S.group_split(table, small=small)
    per_group = split.groupBy("repo_name").agg(F.count_distinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r["n"] == 1 for r in per_group)
    assert sorted(r["s"] for r in per_group) == ["test"] * 2 + ["train"] * 6 + ["validation"]


def test_stratified_sizes():
    # A published split of 23,890 rows.
    assert sum(S.stratified_test_sizes({0: 20000, 1: 3890}, 0.3).values()) == 7167
    assert S.stratified_test_sizes({0: 5, 1: 5}, 0.3) == {0: 2, 1: 1}


@pytest.mark.parametrize("small", [10, 50_000])
def test_stratified_split(table, small):
    labeled = E.labeled_rows(table)
    counts = E.require_two_classes(labeled)
    got = {(r[0], r[1]): r[2] for r in S.stratified_split(labeled, small=small).groupBy("bug_label", "split").count().collect()}
    sizes = S.stratified_test_sizes(counts, 0.3)
    assert {c: got[(c, "test")] for c in counts} == sizes


def test_guards(spark, table):
    with pytest.raises(ValueError, match="missing"):
        E.require_columns(table, ["nope"])
    with pytest.raises(ValueError, match="both"):
        E.require_two_classes(E.labeled_rows(table.where("bug_label = '1'")))
    with pytest.raises(ValueError, match="no labelled"):
        E.require_two_classes(E.labeled_rows(table.where("bug_label = ''")))
    with pytest.raises(ValueError, match="file_id"):
        E.merge_history(table.drop("file_id"), None)
    with pytest.raises(ValueError, match="only"):
        E.require_two_classes(table.select(F.lit(7).alias("bug_label")))


def test_rows_without_metrics_are_not_trained_on(spark):
    bare = spark.createDataFrame([("repos", "m", "", "1", "", "", "1", "")],
                                  "file string, function string, nloc string, ccn string, params string, length string, "
                                  "radon_cc string, bug_label string")
    assert E.labeled_rows(bare, ["nloc", "ccn", "params", "length", "radon_cc"]).count() == 0


def test_merge_keeps_all_functions_and_prefers_history_labels(spark):
    fns = spark.createDataFrame([("f1", "a", "1"), ("f2", "b", "0"), ("f3", None, "")], "function_id string, file_id string, bug_label string")
    hist = spark.createDataFrame([("a", 0, 5), ("a", 1, 9), ("c", 1, 1)], "file_id string, bug_label int, commit_count bigint")
    for bound in (1, 1000):
        rows = {r["function_id"]: r for r in E.merge_history(fns, hist, max_group_rows=bound).collect()}
        assert (rows["f1"]["bug_label"], rows["f1"]["commit_count"]) == (0.0, 5)
        assert (rows["f2"]["bug_label"], rows["f2"]["commit_count"]) == (0.0, None)
        assert rows["f3"]["bug_label"] is None and rows["f3"]["total_churn"] == 0


def newton(x, y, w):
    """Minimiser of the summed weighted log loss plus half the squared norm, intercept free."""
    z = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        gradient = z.T @ (w * (p - y)) + penalty @ beta
        hessian = (z * (w * p * (1 - p))[:, None]).T @ z + penalty
        beta -= np.linalg.solve(hessian, gradient)
    return 1 / (1 + np.exp(-z @ beta))


def test_logistic_minimises_the_penalised_loss(table):
    features = ["nloc", "ccn", "params", "length"]
    labeled = E.labeled_rows(coerce_numeric(table, features))
    train = T.weighted(labeled, E.require_two_classes(labeled)).withColumn(
        "bug_label", F.when(F.col("ccn") > 9, 1).otherwise(F.col("bug_label")))
    pdf = train.select("function_id", *features, "bug_label", "weight").toPandas()
    x = pdf[features].to_numpy()
    want = newton((x - x.mean(0)) / x.std(0), pdf["bug_label"].to_numpy(), pdf["weight"].to_numpy())
    model = T.train_logistic(train, features)
    got = T.score(model, train, features, 0.5).select("function_id", "bug_probability").toPandas()
    merged = pdf.assign(want=want).merge(got, on="function_id")
    assert np.abs(merged["want"] - merged["bug_probability"]).max() < 1e-4


def test_score_keeps_given_values(spark, table):
    labeled = E.labeled_rows(coerce_numeric(table, STATIC_FEATURES))
    model = T.train_forest(T.weighted(labeled, E.require_two_classes(labeled)), STATIC_FEATURES, SMALL)
    odd = table.limit(5).withColumn("nloc", F.lit("many")).drop("token")
    rows = T.score(model, odd, STATIC_FEATURES, 0.5).collect()
    assert {r["nloc"] for r in rows} == {"many"} and all(0 <= r["bug_probability"] <= 1 for r in rows)
    assert all(r["predicted_bug_label"] == int(r["bug_probability"] >= 0.5) for r in rows)
    importance = T.feature_importance(spark, model, STATIC_FEATURES).orderBy("rank").collect()
    assert [r["rank"] for r in importance] == list(range(1, 11))
    assert sum(r["importance"] for r in importance) == pytest.approx(1)


def test_run_store_load_and_score(spark, table, tmp_path):
    history = table.select("file_id").distinct().limit(60).withColumns(
        {"bug_label": F.pmod(F.hash("file_id"), F.lit(2)), "commit_count": F.lit(3)})
    merged, trained = T.run_training(table, history, SMALL)
    assert set(trained) == {"static_only", "combined"} and trained["combined"].features == COMBINED_FEATURES
    for each in trained.values():
        assert each.rows == table.count() and set(each.results) == {"random_forest", "logistic_regression"}
        best = max(r["validation"]["f1_score"] for r in each.results.values())
        assert each.validation_f1 == best
    folder = f"file://{tmp_path}/run"
    T.write_training(merged, trained, folder)
    predictions = spark.read.json(f"{folder}/combined_predictions")
    assert set(predictions.columns) == set(PREDICTION_COLUMNS) and predictions.count() == table.count()
    assert spark.read.json(f"{folder}/training_summary").count() == 8
    runs = {r["feature_set"]: r for r in spark.read.json(f"{folder}/training_run").collect()}
    assert runs["combined"]["best_threshold"] == trained["combined"].threshold and runs["static_only"]["history_found"]
    assert spark.read.json(f"{folder}/importances").groupBy("feature_set").count().count() == 2
    reports = spark.read.json(f"{folder}/reports").groupBy("feature_set", "model_name", "split").count()
    assert {r["count"] for r in reports.collect()} == {5} and reports.count() == 8
    ends = spark.read.json(f"{folder}/curves").groupBy("feature_set", "model_name", "split").agg(F.max("fpr"), F.max("tpr"))
    assert {tuple(r)[3:] for r in ends.collect()} == {(1.0, 1.0)} and ends.count() == 8
    model, features, threshold, message = T.load_best_model(spark, folder)
    assert features == STATIC_FEATURES and threshold == trained["static_only"].threshold and message == "Model ready"
    assert T.load_best_model(spark, folder, with_history=True)[1] == COMBINED_FEATURES
    ranked = scoring.score_rows(table, model, features, threshold)
    by_model = ranked.where("bug_probability IS NOT NULL").select("language").distinct().collect()
    assert [r[0] for r in by_model] == ["Python"]
    assert ranked.count() == table.count()
    merged.unpersist()


def test_no_model(spark, tmp_path):
    assert T.load_best_model(spark, f"file://{tmp_path}/none") == (None, [], 0.5, T.NO_MODEL)
    broken = tmp_path / "static_only_model" / "metadata"
    broken.mkdir(parents=True)
    (broken / "part.json").write_text('{"features": ["nloc"], "threshold": 0.4}\n')
    model, features, threshold, message = T.load_best_model(spark, f"file://{tmp_path}")
    assert (model, features, threshold) == (None, [], 0.5)


def test_score_all_and_roc_experiment(table):
    rows = T.train_and_score_all(table, SMALL)
    assert rows.count() == table.count() and rows.columns[-1] == "bug_probability"
    curve, auc = T.roc_experiment(table, SMALL)
    assert 0 <= auc.first()[0] <= 1 and curve.count() > 2
