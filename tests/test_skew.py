import hashlib
import random

import pytest
from pyspark.sql import Window, functions as F

from defectlens.operators import skew


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    # One group holds a third of all rows, one group is null, scores have many ties.
    groups = ["hot"] * 400 + [None] * 150 + [f"g{draw.randrange(60)}" for _ in range(650)]
    draw.shuffle(groups)
    data = [(i, g, draw.randrange(12), draw.randrange(5)) for i, g in enumerate(groups)]
    return spark.createDataFrame(data, "id int, g string, score int, n int").cache()


def window_sums(df, by, order):
    group = Window.partitionBy(*by)
    upto = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({
        "rank": F.sum(F.lit(1)).over(upto), "total": F.sum("n").over(upto),
        "rank_total": F.sum(F.lit(1)).over(group), "total_total": F.sum("n").over(group),
    })


@pytest.mark.parametrize("by", [["g"], [], ["g", "score"]])
@pytest.mark.parametrize("bound", [40, 10_000])
def test_prefix_sums_equal_window_sums(rows, by, bound):
    order = [F.col("score").desc(), F.col("id").asc()]
    measures = {"rank": F.lit(1), "total": F.col("n")}
    got = skew.prefix_sums(rows, by, order, measures, max_group_rows=bound)
    want = window_sums(rows, by, order)
    names = ["id", "g", "score", "n", "rank", "total", "rank_total", "total_total"]
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect()))


def test_sliced_plan_gives_no_task_a_whole_hot_group(rows):
    order = [F.col("score").desc(), F.col("id").asc()]
    sliced = skew.prefix_sums(rows, ["g"], order, {"rank": F.lit(1)}, max_group_rows=40)
    plan = sliced._jdf.queryExecution().toString()
    assert "_slice" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("bound", [50, 10_000])
def test_join_lookup_equals_left_join(spark, rows, bound):
    lookup = spark.createDataFrame([("hot", "H"), ("g1", "one"), ("g2", "two"), ("absent", "x")], "g string, v string")
    got = skew.join_lookup(rows, lookup, "g", max_group_rows=bound).select("id", "g", "v")
    want = rows.join(lookup, "g", "left").select("id", "g", "v")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_salted_join_spreads_the_hot_key(spark, rows):
    lookup = spark.createDataFrame([("hot", "H")], "g string, v string")
    plan = skew.join_lookup(rows, lookup, "g", max_group_rows=50)._jdf.queryExecution().toString()
    assert "_salt" in plan


@pytest.mark.parametrize("small", [1, 5, 50_000])
def test_kth_smallest_hex(rows, small):
    digests = rows.select(F.md5(F.col("id").cast("string")).alias("d"))
    want = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(1200))
    ranks = [0, 1, 17, 700, 1200]
    histogram = skew.hex_histogram(digests, "d", 1)
    assert sum(n for _, n in histogram) == 1200
    got = skew.kth_smallest_hex(digests, "d", ranks, histogram, small)
    assert got == {k: want[k - 1] if k else "" for k in ranks}


def test_null_keys_are_spread_too(spark):
    left = spark.range(300).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' END AS g")
    lookup = spark.createDataFrame([("a", 1), (None, 2)], "g string, v int")
    assert [tuple(r) for r in skew.hot_keys(left, "g", 150).collect()] == [(None, 2)]
    assert skew.hot_keys(left, "g", 500) is None
    got = skew.join_lookup(left, lookup, "g", max_group_rows=150)
    assert sorted(map(tuple, got.select("id", "v").collect())) == [(i, 1 if i % 3 == 0 else None) for i in range(300)]


def test_shared_folder():
    from types import SimpleNamespace

    from defectlens.session import shared_folder

    def session(folder, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder),
                               sparkContext=SimpleNamespace(master=master, applicationId="app"))

    assert shared_folder(session("hdfs:///x/", "yarn")) == "hdfs:///x"
    assert shared_folder(session(None, "local[2]")).endswith("defectlens-app")
    with pytest.raises(ValueError):
        shared_folder(session(None, "yarn"))


def test_equal_keys_are_cut_apart(spark):
    rows = spark.range(600).selectExpr("'one' AS g", "1 AS score", "id")
    ranked = skew.prefix_sums(rows, ["g"], [F.col("score").desc()], {"rank": F.lit(1)}, max_group_rows=100)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 601))
    assert ranked.columns == ["g", "score", "id", "rank", "rank_total"]
    slices = skew._sliced_prefix_sums(rows, ["g"], [F.col("score").desc()], {"rank": F.lit(1)}, 6)
    assert slices.where("rank_total <> 600").count() == 0


def test_hundreds_of_hot_keys_are_all_split(spark):
    left = spark.range(300 * 40).selectExpr("id", "id % 300 AS g", "id % 7 AS other").unionByName(spark.range(4000).selectExpr("id", "-1L AS g", "0L AS other"))
    lookup = spark.range(-1, 300).selectExpr("id AS g", "id * 2 AS v")
    hot = {r["g"]: r["_salts"] for r in skew.hot_keys(left, "g", 10).collect()}
    assert len(hot) == 301 and hot[-1] == 400 and hot[5] == 4
    got = skew.join_lookup(left, lookup, "g", max_group_rows=10)
    assert got.count() == left.count() and got.where("v <> 2 * g OR v IS NULL").count() == 0


def test_ranks_depend_on_the_rows_alone(spark):
    """Many rows equal in the order: every plan and partitioning ranks them alike."""
    rows = spark.range(200).selectExpr("'f' AS g", "id % 2 AS score", "CAST(id AS STRING) AS payload")
    ranks = []
    for parts, limit in ((1, 10_000), (7, 10_000), (3, 20), (5, 60)):
        df = rows.repartition(parts).orderBy(F.rand(parts))
        ranked = skew.prefix_sums(df, ["g"], [F.col("score").desc()], {"rank": F.lit(1)}, max_group_rows=limit)
        ranks.append({r["payload"]: r["rank"] for r in ranked.collect()})
    assert all(r == ranks[0] for r in ranks) and sorted(ranks[0].values()) == list(range(1, 201))


@pytest.mark.parametrize("small", [1, 20, 10_000])
def test_ranked_hex_selects_for_all_groups_at_once(spark, small):
    draw = random.Random(4)
    data = [(g, hashlib.md5(f"{g}{i}".encode()).hexdigest()) for g in range(30) for i in range(draw.randrange(1, 80))] + [(30, "0" * 32)] * 5
    groups = {g: sorted(d for other, d in data if other == g) for g in range(31)}
    ranks = {g: draw.randrange(0, len(digests) + 1) for g, digests in groups.items()}
    counts, ends = skew.ranked_hex(spark.createDataFrame(data, "g int, d string"), "g", "d", lambda sizes: ranks, small)
    assert counts == {g: len(d) for g, d in groups.items()}
    assert ends == {g: groups[g][rank - 1] if rank else "" for g, rank in ranks.items()}


def test_named_ties_read_no_other_columns(spark, rows):
    ranked = skew.prefix_sums(rows.withColumn("other", F.rand()), ["g"], [F.col("score").desc()], {"rank": F.lit(1)}, max_group_rows=10_000, ties=["id"])
    same = skew.prefix_sums(rows, ["g"], [F.col("score").desc()], {"rank": F.lit(1)}, max_group_rows=40, ties=["id", "absent"])
    assert {(r["id"], r["rank"]) for r in ranked.collect()} == {(r["id"], r["rank"]) for r in same.collect()}


def test_a_small_bound_does_not_make_slices_without_end(rows, monkeypatch):
    """The driver samples up to 300 rows per slice, so their number must not grow with every 500 rows."""
    assert [skew.slice_count(n, 500) for n in (10, 1_200, 54_000_000)] == [2, 3, skew.MANY_SLICES]
    assert skew.slice_count(5_000_000_000, skew.MAX_GROUP_ROWS) == skew.slice_count(5_000_000_000, 500) == 5_000
    monkeypatch.setattr(skew, "MANY_SLICES", 4)
    order = [F.col("score").desc(), F.col("id").asc()]
    got = skew.prefix_sums(rows, ["g"], order, {"rank": F.lit(1), "total": F.col("n")}, max_group_rows=5)
    names = ["id", "rank", "total", "rank_total", "total_total"]
    assert sorted(got.select(names).collect()) == sorted(window_sums(rows, ["g"], order).select(names).collect())
