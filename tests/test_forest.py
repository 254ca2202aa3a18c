import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from defectlens.operators import forest as Y
from defectlens.plans import training as T


def sample(seed, n, features=5, values=12):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, values, (n, features)).astype(float)
    return x, ((x[:, 0] + x[:, 1] * x[:, 2]) % 3 == 0).astype(np.int64)


def test_sample_weights_are_balanced_in_each_bootstrap():
    labels = np.array([0] * 90 + [1] * 10)
    for tree in range(20):
        growth = Y.Growth(20, seed=7)
        weight = Y.bootstrap(labels, np.ones(100), tree, growth)
        drawn = np.zeros(100)
        for i in np.random.default_rng((7, tree)).integers(0, 100, 100):
            drawn[i] += 1
        ones = sum(drawn[90:])
        want = [d * (0 if d == 0 else 100 / (2 * (ones if y else 100 - ones))) for d, y in zip(drawn, labels)]
        assert np.allclose(weight, want) and weight[:90].sum() == pytest.approx(weight[90:].sum())
        assert (weight == Y.bootstrap(labels, np.ones(100), tree, growth)).all()  # a repeated task draws the same rows
    plain = Y.bootstrap(labels, np.full(100, 3.0), 1, Y.Growth(20, balance_samples=False))
    assert plain.sum() == pytest.approx(300) and set(plain % 3) == {0}


def brute_best(x, w0, w1, min_leaf):
    """The best score over all features and borders of one node."""
    best = -np.inf
    for f in range(x.shape[1]):
        for border in sorted(set(x[:, f]))[:-1]:
            low = x[:, f] <= border
            if min(low.sum(), (~low).sum()) >= min_leaf:
                score = sum((w0[s].sum() ** 2 + w1[s].sum() ** 2) / (w0[s].sum() + w1[s].sum()) for s in (low, ~low))
                best = max(best, score)
    return best


@pytest.mark.parametrize("min_leaf", [1, 2, 9])
def test_best_splits_against_all_borders(min_leaf):
    x, y = sample(1, 120)
    weight = np.random.default_rng(2).random(120)
    w0, w1 = np.where(y == 0, weight, 0), np.where(y == 1, weight, 0)
    node = np.random.default_rng(3).integers(-1, 4, 120)
    found = Y._best_splits(x, np.argsort(x, axis=0, kind="stable").T, node, 4, w0, w1, min_leaf)
    for k in range(4):
        rows = node == k
        assert found.score[k].max() == pytest.approx(brute_best(x[rows], w0[rows], w1[rows], min_leaf))


def test_trees_grow_to_pure_leaves_beyond_ten_levels():
    x = np.arange(4096.0)[:, None]
    y = (np.arange(4096) % 2).astype(np.int64)
    impurity, a, b, rows, gain, left, right, feature, threshold = Y.grow(x, y, np.ones(4096), 3, Y.Growth(5, min_leaf=1))
    depth = np.zeros(len(left), dtype=int)
    for i in np.flatnonzero(left >= 0):
        depth[left[i]] = depth[right[i]] = depth[i] + 1
        assert (rows[left[i]] + rows[right[i]], a[left[i]] + a[right[i]]) == (rows[i], pytest.approx(a[i]))
    leaves = left < 0
    assert depth.max() > 10 and impurity[leaves].max() < 1e-9 and (np.minimum(a, b)[leaves] < 1e-9).all()
    assert Y.grow(x, y, np.ones(4096), 3, Y.Growth(5, depth=4))[5].size <= 31


def test_same_scores_as_spark_reads_and_gives(spark, tmp_path):
    x, y = sample(5, 700)
    names = [f"f{i}" for i in range(5)]
    rows = spark.createDataFrame([(*map(float, r), int(label), 1.0) for r, label in zip(x, y)], ", ".join(f"{n} double" for n in names) + ", bug_label int, weight double")
    settings = T.ForestSettings(trees=12, min_leaf=2)
    model = T.train_forest(rows, names, settings)
    again = T.train_forest(rows.repartition(3), names, settings)  # order and partitions of the rows do not matter
    scored = T.score(model, rows, names, 0.5).select(*names, "bug_probability").orderBy(*names).collect()
    assert scored == T.score(again, rows, names, 0.5).select(*names, "bug_probability").orderBy(*names).collect()
    model.save(f"file://{tmp_path}/m")
    loaded = PipelineModel.load(f"file://{tmp_path}/m")
    theirs = loaded.transform(rows).select(*names, vector_to_array("probability")[1].alias("p")).orderBy(*names).collect()
    assert np.allclose([r["bug_probability"] for r in scored], [r["p"] for r in theirs])
    assert np.allclose(model.importances(), loaded.stages[-1].featureImportances.toArray())
    right = [(r["bug_probability"] >= 0.5) == ((r["f0"] + r["f1"] * r["f2"]) % 3 == 0) for r in scored]
    assert np.mean(right) > 0.9 and loaded.stages[-1].totalNumNodes > 500


def test_large_tables_are_left_to_spark(spark):
    x, y = sample(6, 200)
    rows = spark.createDataFrame([(float(r[0]), float(r[1]), int(label), 1.0) for r, label in zip(x, y)], "a double, b double, bug_label int, weight double")
    model = T.train_forest(rows, ["a", "b"], T.ForestSettings(trees=3, max_values=399))
    assert isinstance(model, PipelineModel) and model.stages[-1].getOrDefault("maxDepth") == 30
    assert T.score(model, rows.withColumn("x", F.lit(1)), ["a", "b"], 0.5).columns == ["a", "b", "bug_label", "weight", "x", "bug_probability", "predicted_bug_label"]


def test_forests_of_any_size_are_scored_the_same_without_the_driver(spark, monkeypatch):
    x, y = sample(8, 600)
    names = [f"f{i}" for i in range(5)]
    rows = spark.createDataFrame([(i, *map(float, r), int(label), 1.0) for i, (r, label) in enumerate(zip(np.vstack([x, x[:50]]), np.r_[y, y[:50]]))],
                                 "i int, " + ", ".join(f"{n} double" for n in names) + ", bug_label int, weight double")
    model = T.train_forest(rows, names, T.ForestSettings(trees=9))
    want = [r[0] for r in T.score(model, rows, names, 0.5).orderBy("i").select("bug_probability").collect()]
    largest = max(model.sizes.values())
    for limit in (largest, 3 * largest):  # parts of a tree or of some
        monkeypatch.setattr(Y, "MAX_NODES", 100)
        monkeypatch.setattr(Y, "PART_NODES", limit)
        monkeypatch.setattr(Y, "PART_VALUES", 500)  # several blocks of rows
        again = T.open_model(spark, model.path, names)
        assert isinstance(again, Y.GrownForest)  # Spark ML would load all nodes into the driver
        monkeypatch.setattr(type(model.nodes), "toArrow", None)  # nor may they come as arrays
        scored = T.score(again, rows, names, 0.5).orderBy("i").select("i", "bug_probability").collect()
        monkeypatch.undo()
        assert [r["i"] for r in scored] == list(range(650))
        assert np.allclose([r["bug_probability"] for r in scored], want, rtol=0, atol=1e-12)


def plain_split(x, w0, w1, rows, f, min_leaf):
    """The best border of a feature among the rows, by a loop: score and threshold."""
    values, best = np.unique(x[rows, f]), (-np.inf, 0.0)
    for low, high in zip(values[:-1], values[1:]):
        left, right = rows[x[rows, f] <= low], rows[x[rows, f] > low]
        if min(len(left), len(right)) >= min_leaf:
            score = sum((w0[s].sum() ** 2 + w1[s].sum() ** 2) / (w0[s].sum() + w1[s].sum()) for s in (left, right))
            if score > best[0] + 1e-12:
                best = score, (low + high) / 2
    return best


def test_best_splits_of_rows_that_are_left():
    x, y = sample(9, 300, features=3)
    orders, w0, w1 = Y.sorted_orders(x), (y == 0).astype(float), (y == 1).astype(float)
    by = Y._Sorted(x, orders)
    rng = np.random.default_rng(4)
    rows = np.arange(300)
    for _ in range(3):  # rows of leaves are dropped level by level
        on = rng.random(len(rows)) < 0.7
        rows = rows[on]
        by.keep(on)
        node = rng.integers(0, 5, len(rows)).astype(np.int32)
        wanted = rng.random((6, 3)) < 0.6  # node 5 has no rows
        found = Y._best_splits(x, orders, node, 6, w0, w1, 2, wanted, by)
        for k in range(6):
            for f in range(3):
                want = plain_split(x, w0, w1, rows[node == k], f, 2) if wanted[k, f] and (node == k).any() else (-np.inf, 0.0)
                assert found.score[k, f] == pytest.approx(want[0]) and found.threshold[k, f] == want[1]


def test_each_group_of_trees_is_a_task_of_its_own(spark):
    x, y = sample(10, 60, features=3)
    rows = spark.createDataFrame([(*map(float, r[:2]), int(label), 1.0) for r, label in zip(x, y)], "a double, b double, bug_label int, weight double")
    nodes = Y.grow_forest(rows, ["a", "b"], "bug_label", Y.Growth(64))
    groups = nodes.where("nodeData.id = 0").select("treeID", F.spark_partition_id().alias("task")).collect()
    n = min(64, Y.GROUPS, max(8, spark.sparkContext.defaultParallelism))
    assert {(r["treeID"] % n, r["task"]) for r in groups} == {(g, g) for g in range(n)}


@pytest.mark.parametrize("min_leaf,balance", [(1, False), (7, True)])
def test_equal_rows_counted_grow_the_trees_of_single_rows(monkeypatch, min_leaf, balance):
    monkeypatch.setattr(Y, "DRAWS", 1000)
    x, y = sample(6, 6000, features=3, values=5)
    y ^= np.random.default_rng(9).integers(0, 4, 6000) == 0
    order = np.lexsort((y, *x.T))
    x, y = x[order], y[order]
    new = np.flatnonzero(np.r_[True, (np.diff(x, axis=0) != 0).any(axis=1) | (np.diff(y) != 0)])
    times = np.diff(np.r_[new, len(y)])
    assert len(new) <= 250
    growth = Y.Growth(4, min_leaf=min_leaf, balance_samples=balance)
    for tree in range(4):
        drawn, rows = Y.draws(len(new), tree, growth, times)
        single = Y.draws(len(y), tree, growth)
        assert (drawn == np.add.reduceat(single[0], new)).all() and (rows == np.add.reduceat(single[1].astype(int), new)).all()
        weights = np.ones(len(y))
        plain, counted = Y.grow(x, y, weights, tree, growth), Y.grow(x[new], y[new], weights[new], tree, growth, times=times)
        if balance:  # weights of a balanced sample are no round numbers, so that ties of borders may fall otherwise
            assert plain[3][0] == counted[3][0] and min(counted[3]) >= min_leaf and np.allclose(plain[1][0], counted[1][0])
        else:
            assert all(np.array_equal(a, b) for a, b in zip(plain, counted))


def test_many_rows_train_on_counted_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "MANY_ROWS", 1000)
    x, y = sample(8, 4000, features=3, values=4)
    rows = [(float(a), float(b), float(c), int(d), 1.0, "more") for (a, b, c), d in zip(x, y)]
    train = spark.createDataFrame(rows, "a double, b double, c double, bug_label int, weight double, _times string")
    seen, plain = [], T.grow_forest
    monkeypatch.setattr(T, "grow_forest", lambda df, *more: seen.append(df.count()) or plain(df, *more))
    settings = T.ForestSettings(trees=3, min_leaf=1, balance_samples=False)
    found = T.score(T.train_forest(train, ["a", "b", "c"], settings), train, ["a", "b", "c"], 0.5)
    monkeypatch.setattr(T, "MANY_ROWS", 10_000)
    other = T.score(T.train_forest(train, ["a", "b", "c"], settings), train, ["a", "b", "c"], 0.5)
    columns = ["a", "b", "c", "bug_probability"]
    assert seen[0] <= 128 and seen[1] == 4000
    assert sorted(found.select(columns).collect()) == sorted(other.select(columns).collect())
