"""Training, model choice, scoring and the model store."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from defectlens.functions.numbers import clean_value, coerce_numeric, numeric
from defectlens.operators.evaluate import classification_report, evaluate_scores, roc_auc, roc_curve
from defectlens.operators.features import (
    class_counts, labeled_rows, merge_history, require_two_classes, with_group,
)
from defectlens.operators.forest import GrownForest, Growth, counted_rows, grow_forest
from defectlens.operators.split import group_split, stratified_split
from defectlens.schemas import (
    BASIC_FEATURES, COMBINED_FEATURES, PREDICTION_COLUMNS, ROC_FEATURES, PREDICTION_TYPES, SHORT_PREDICTION_COLUMNS, STATIC_FEATURES,
)
from defectlens.session import materialize, new_table_path
from defectlens.sources.tables import write_json

LABEL = "bug_label"
READY = "Model ready"
MANY_ROWS = 1_000_000  # of a training table whose equal rows are counted first
SPARK_DEPTH = 30  # the most levels that Spark ML grows
NO_MODEL = "Upload a file to begin. Python files use the saved model when available."
log = logging.getLogger(__name__)
Model = PipelineModel | GrownForest


@dataclass(frozen=True)
class ForestSettings:
    """Trees grow until their leaves are pure or too small to split, unless ``depth`` bounds them.

    ``balance_samples`` balances the class weights in the bootstrap sample of each tree, else they are those of all rows. Tables of any size are
    trained alike. Only a caller who sets ``max_values`` has tables of more (rows times features) left to Spark ML's level-wise forest, which
    stops at 30 levels and has the weights of all rows.
    """

    trees: int = 300
    depth: int | None = None
    min_leaf: int = 2
    seed: int = 42
    balance_samples: bool = True
    max_values: int | None = None


@dataclass
class TrainedSet:
    """Outcome of one feature set: the chosen model and the metrics of all candidates."""

    name: str
    features: list[str]
    model_name: str
    model: Model
    threshold: float
    validation_auc: float | None
    validation_f1: float
    rows: int
    labeled_rows: int
    results: dict[str, dict]
    models: dict[str, Model]
    history_found: bool = False


def class_weights(counts: dict[int, int]) -> dict[int, float]:
    """Balanced weights: all rows / (classes * rows of the class)."""
    rows = sum(counts.values())
    return {value: rows / (len(counts) * n) for value, n in counts.items()}


def weighted(df: DataFrame, counts: dict[int, int], label: str = LABEL) -> DataFrame:
    branches = [(F.col(label) == value, F.lit(w)) for value, w in class_weights(counts).items()]
    weight = reduce(lambda chain, b: chain.when(*b), branches[1:], F.when(*branches[0]))
    return df.withColumn("weight", weight)


def spread(df: DataFrame) -> DataFrame:
    """Even partitions for the many passes of training; selected rows lie unevenly where repositories lie together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def train_forest(train: DataFrame, features: list[str], settings: ForestSettings = ForestSettings()) -> Model:
    """``train`` needs the features, a 0/1 ``bug_label`` and ``weight``."""
    rows = train.count()
    if not rows:
        raise ValueError("no rows to train on")
    grown = settings.max_values is None or rows * len(features) <= settings.max_values
    train = train.select(*features, LABEL, "weight")  # nothing else is seen, whatever its name
    if grown and rows > MANY_ROWS:  # the trees are the same either way
        counted = materialize(counted_rows(train, features, LABEL), "counted_rows")
        train = counted if 2 * counted.count() <= rows else train
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=LABEL, weightCol="weight", numTrees=settings.trees, minInstancesPerNode=settings.min_leaf,
        featureSubsetStrategy="sqrt", seed=settings.seed, maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10,
        maxDepth=0 if grown else min(settings.depth or SPARK_DEPTH, SPARK_DEPTH),
    )
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest])
    if not grown:
        return pipeline.fit(train)
    # Stumps of a row per class are a frame in Spark ML's format; the trees grown in tasks take their place.
    two = train.sparkSession.range(2).select(*[F.lit(0.0).alias(c) for c in features], F.col("id").cast("int").alias(LABEL), F.lit(1.0).alias("weight"))
    model = pipeline.fit(two)
    path = new_table_path(train.sparkSession, "forest")
    model.write().save(path)
    growth = Growth(settings.trees, settings.min_leaf, settings.depth, settings.seed, settings.balance_samples)
    nodes = grow_forest(train, features, LABEL, growth)
    nodes.write.mode("overwrite").parquet(f"{path}/stages/1_{model.stages[1].uid}/data")
    return open_model(train.sparkSession, path, features, model)


def open_model(spark: SparkSession, path: str, features: list[str], frame: PipelineModel | None = None) -> Model:
    """The model stored at ``path``: a forest is scored from its nodes, all else by Spark ML."""
    try:
        return GrownForest(spark, path, features, frame)
    except FileNotFoundError:
        return PipelineModel.load(path)


def train_logistic(train: DataFrame, features: list[str], max_iter: int = 5000) -> PipelineModel:
    """Logistic regression with an L2 penalty (C = 1) on standardised features; input as for ``train_forest``.

    Spark averages the loss over the weights, so the penalty is divided by their sum. Its scaler divides by the sample
    deviation; the factor (n - 1) / n makes that the penalty on features scaled by the population deviation.
    """
    rows, total = train.agg(F.count(F.lit(1)), F.sum("weight")).first()
    logistic = LogisticRegression(
        featuresCol="features", labelCol=LABEL, weightCol="weight", maxIter=max_iter, tol=1e-6,
        regParam=(rows - 1) / rows / total, elasticNetParam=0.0, standardization=False,
    )
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw_features"), scaler, logistic]).fit(train)


def score(model: Model, df: DataFrame, features: list[str], threshold: float) -> DataFrame:
    """Add ``bug_probability`` and ``predicted_bug_label``; features that are absent or no numbers count as 0.

    The table's own values stay as they are: the model sees coerced copies.
    """
    inputs = [
        (F.coalesce(numeric(df, c), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c) for c in features
    ]
    rows = F.struct(*df.columns).alias("_row")
    if isinstance(model, GrownForest):
        scored = model.score(df.select(rows, F.array(*inputs).alias("_x")), "_row", "_x", "bug_probability")
    else:
        scored = model.transform(df.select(rows, *inputs)).select("_row", vector_to_array("probability")[1].alias("bug_probability"))
    return scored.select("_row.*", "bug_probability").withColumn(
        "predicted_bug_label", (F.col("bug_probability") >= threshold).cast("int")
    )


def feature_importance(spark: SparkSession, model: Model, features: list[str]) -> DataFrame:
    """(feature, importance, rank): impurity importance of a forest, else |coefficient| of the scaled feature."""
    if isinstance(model, GrownForest):
        values = model.importances()
    elif hasattr(fitted := model.stages[-1], "featureImportances"):
        values = fitted.featureImportances.toArray()
    else:
        values = abs(fitted.coefficients.toArray())
    ordered = sorted(zip(features, map(float, values)), key=lambda pair: -pair[1])
    rows = [(name, value, rank) for rank, (name, value) in enumerate(ordered, start=1)]
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE, rank INT")


def prediction_rows(scored: DataFrame, model_name: str, feature_set: str, threshold: float) -> DataFrame:
    """The prediction table; columns that ``scored`` lacks are null."""
    given = {"model_name": F.lit(model_name), "feature_set": F.lit(feature_set), "threshold": F.lit(float(threshold))}
    return scored.select([given.get(c, _prediction(scored, c)).alias(c) for c in PREDICTION_COLUMNS])


def _prediction(scored: DataFrame, name: str) -> Column:
    """The column, or nulls of the type it has where it is present."""
    return clean_value(scored, name) if name in scored.columns else F.lit(None).cast(PREDICTION_TYPES.get(name, "double"))


def prediction_rows_short(scored: DataFrame) -> DataFrame:
    return scored.select([_prediction(scored, c).alias(c) for c in SHORT_PREDICTION_COLUMNS])


def train_feature_set(
    df: DataFrame, name: str, features: list[str], settings: ForestSettings = ForestSettings(), seed: int = 42
) -> TrainedSet:
    """Train both models on the train groups, tune each threshold on validation, keep the one with the better F1."""
    data = coerce_numeric(df, features)
    labeled = with_group(labeled_rows(data))
    require_two_classes(labeled)
    # Written once: the many passes of training read it, whatever executors are lost.
    sides = materialize(spread(group_split(labeled, seed=seed)).select(*features, LABEL, "split"), "training_rows")
    train = sides.where(F.col("split") == "train")
    train = weighted(train, require_two_classes(train))
    models = {
        "random_forest": train_forest(train, features, settings),
        "logistic_regression": train_logistic(train, features),
    }
    results = {}
    for model_name, model in models.items():
        results[model_name] = _tune(model, sides, features)
    best = max(results, key=lambda n: results[n]["validation"]["f1_score"])  # the first of equals
    return TrainedSet(
        name=name,
        features=features,
        model_name=best,
        model=models[best],
        threshold=results[best]["threshold"],
        validation_auc=results[best]["validation"]["roc_auc"],
        validation_f1=results[best]["validation"]["f1_score"],
        rows=data.count(),
        labeled_rows=sides.count(),
        results=results,
        models=models,
    )


def _tune(model: Model, sides: DataFrame, features: list[str]) -> dict:
    held_out = sides.where(F.col("split") != "train")
    # Written once: thresholds, curves and reports of both sides come from these scores.
    scored = materialize(score(model, held_out, features, 0.5).select(LABEL, "bug_probability", "split"), "held_out_scores")
    validation, test = (scored.where(F.col("split") == side) for side in ("validation", "test"))
    tuned = evaluate_scores(validation).first().asDict()
    threshold = tuned["threshold"]
    sides_scored = {"validation": validation, "test": test}
    return {
        "threshold": threshold,
        "validation": tuned,
        "test": evaluate_scores(test, threshold).first().asDict(),
        # Tables of any length are made only when they are asked for.
        "curves": {side: partial(roc_curve, rows, drop_intermediate=True) for side, rows in sides_scored.items()},
        "reports": {side: partial(classification_report, rows, threshold) for side, rows in sides_scored.items()},
    }


def metrics_table(spark: SparkSession, trained: list[TrainedSet]) -> DataFrame:
    """One row per feature set, model and side."""
    rows = []
    for each in trained:
        for model_name, result in each.results.items():
            for side in ("validation", "test"):
                m = result[side]
                rows.append((each.name, model_name, side, model_name == each.model_name, result["threshold"],
                             m["precision"], m["recall"], m["f1_score"], m["accuracy"], m["roc_auc"],
                             m["tn"], m["fp"], m["fn"], m["tp"], result["validation"]["selection_rule"]))
    return spark.createDataFrame(
        rows,
        "feature_set STRING, model_name STRING, split STRING, is_best BOOLEAN, threshold DOUBLE, precision DOUBLE, "
        "recall DOUBLE, f1_score DOUBLE, accuracy DOUBLE, roc_auc DOUBLE, tn BIGINT, fp BIGINT, fn BIGINT, tp BIGINT, "
        "selection_rule STRING",
    )


def run_table(spark: SparkSession, trained: list[TrainedSet]) -> DataFrame:
    """One row per feature set: what it was trained on and what was chosen."""
    rows = [(t.name, t.history_found, t.features, t.rows, t.labeled_rows, t.model_name, t.threshold, t.validation_auc,
             t.validation_f1) for t in trained]
    return spark.createDataFrame(
        rows,
        "feature_set STRING, history_found BOOLEAN, features ARRAY<STRING>, rows BIGINT, labeled_rows BIGINT, "
        "best_model_name STRING, best_threshold DOUBLE, best_validation_auc DOUBLE, best_validation_f1 DOUBLE",
    )


def importance_table(spark: SparkSession, trained: list[TrainedSet]) -> DataFrame:
    """Feature importances of all models; ``is_best`` marks those of the chosen one."""
    parts = [
        feature_importance(spark, model, t.features).select(
            F.lit(t.name).alias("feature_set"), F.lit(name).alias("model_name"), F.lit(name == t.model_name).alias("is_best"), "*")
        for t in trained
        for name, model in t.models.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def side_tables(trained: list[TrainedSet], kind: str) -> DataFrame:
    """The ROC ``curves`` or the class ``reports`` of all feature sets, models and sides in one table."""
    parts = [
        make().select(F.lit(each.name).alias("feature_set"), F.lit(model).alias("model_name"), F.lit(side).alias("split"), "*")
        for each in trained
        for model, result in each.results.items()
        for side, make in result[kind].items()
    ]
    return reduce(DataFrame.unionByName, parts)


def run_training(
    functions: DataFrame, history: DataFrame | None, settings: ForestSettings = ForestSettings(), seed: int = 42
) -> tuple[DataFrame, dict[str, TrainedSet]]:
    """The joined table and both trained feature sets, ``static_only`` and ``combined``."""
    merged = materialize(coerce_numeric(merge_history(functions, history), COMBINED_FEATURES), "merged")
    sets = {"static_only": STATIC_FEATURES, "combined": COMBINED_FEATURES}
    trained = {name: train_feature_set(merged, name, features, settings, seed) for name, features in sets.items()}
    for each in trained.values():
        each.history_found = history is not None
    return merged, trained


def predict_all(merged: DataFrame, trained: TrainedSet) -> DataFrame:
    scored = score(trained.model, merged, trained.features, trained.threshold)
    return prediction_rows(scored, trained.model_name, trained.name, trained.threshold)


def write_training(merged: DataFrame, trained: dict[str, TrainedSet], folder: str) -> None:
    """Models, predictions and metrics of a run under ``folder``."""
    spark = merged.sparkSession
    for each in trained.values():
        save_model(spark, each, f"{folder}/{each.name}_model")
        write_json(predict_all(merged, each), f"{folder}/{each.name}_predictions")
    save_model(spark, trained["static_only"], f"{folder}/bug_model")
    sets = list(trained.values())
    write_json(run_table(spark, sets), f"{folder}/training_run")
    write_json(metrics_table(spark, sets), f"{folder}/training_summary")
    write_json(importance_table(spark, sets), f"{folder}/importances")
    for kind in ("curves", "reports"):
        write_json(side_tables(sets, kind), f"{folder}/{kind}")


def train_and_score_all(df: DataFrame, settings: ForestSettings = ForestSettings(trees=100, min_leaf=1, balance_samples=False)) -> DataFrame:
    """Train a forest on all labelled rows and score every row; the result keeps the values as they were given."""
    labeled = spread(labeled_rows(coerce_numeric(df, BASIC_FEATURES)))
    counts = require_two_classes(labeled)
    model = train_forest(weighted(labeled, counts), BASIC_FEATURES, settings)
    return prediction_rows_short(score(model, df, BASIC_FEATURES, 0.5))


def roc_experiment(
    df: DataFrame, settings: ForestSettings = ForestSettings(trees=100, min_leaf=1, balance_samples=False), seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """ROC curve and AUC of a forest on the stratified test rows among the completely known ones."""
    # Written once: each further pass would hash the whole rows of ``df`` again, and both results would score them.
    sides = stratified_split(labeled_rows(df, ROC_FEATURES), seed=seed).select(*ROC_FEATURES, LABEL, "split")
    sides = materialize(sides, "roc_rows")
    train = spread(sides.where(F.col("split") == "train"))
    model = train_forest(weighted(train, class_counts(train)), ROC_FEATURES, settings)
    test = score(model, sides.where(F.col("split") == "test"), ROC_FEATURES, 0.5).select(LABEL, "bug_probability")
    test = materialize(test, "roc_scores")
    return roc_curve(test), roc_auc(test)


def save_model(spark: SparkSession, trained: TrainedSet, path: str) -> None:
    if isinstance(trained.model, GrownForest):
        trained.model.save(f"{path}/pipeline")
    else:
        trained.model.write().overwrite().save(f"{path}/pipeline")
    row = (trained.features, trained.name, trained.model_name, trained.threshold, READY)
    facts = spark.createDataFrame(
        [row],
        "features ARRAY<STRING>, feature_set_name STRING, best_model_name STRING, threshold DOUBLE, status_label STRING",
    )
    write_json(facts.coalesce(1), f"{path}/metadata")


def load_best_model(
    spark: SparkSession, folder: str, with_history: bool = False
) -> tuple[Model | None, list[str], float, str]:
    """(model, features, threshold, message). Without history features the static model is the better informed one."""
    names = ["combined_model", "static_only_model"]
    for name in names if with_history else reversed(names):
        try:
            facts = spark.read.json(f"{folder}/{name}/metadata").first()
            model = open_model(spark, f"{folder}/{name}/pipeline", list(facts["features"]))
            return model, list(facts["features"]), 0.5 if facts["threshold"] is None else float(facts["threshold"]), facts["status_label"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                return None, [], 0.5, f"Could not load saved model: {type(error).__name__}: {error}"
        except Exception as error:  # an unreadable model must not stop rule-based scoring
            return None, [], 0.5, f"Could not load saved model: {type(error).__name__}: {error}"
    return None, [], 0.5, NO_MODEL
