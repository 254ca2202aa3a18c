import random

import pytest
from pyspark.sql import functions as F

from defectlens.llm import decontaminate as D
from helpers import leaks

SCHEMA = "doc_id long, text string, id string, window string, _id string, item_id string"
ITEMS = "item_id long, text string, n string, width string"


def frames(spark, rows, items):
    return (spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA), spark.createDataFrame([(i, t, "x", "x") for i, t in items], ITEMS))


def check(spark, rows, items, **settings):
    docs, benchmark = frames(spark, rows, items)
    got = {(r["id"], r["item_id"]): r["similarity"] for r in D.contaminated(docs, benchmark, **settings).collect()}
    want = leaks(rows, items)
    assert got == pytest.approx(want)
    kept = D.without_leaks(docs, benchmark, **settings)
    assert kept.columns == docs.columns
    dirty = {i for i, _ in want}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in dirty)


def planted(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, some(n)) for i, n in enumerate([14, 20, 35, 35, 59, 120])]
    rows = [(i, " ".join(some(rng.randrange(1, 200)))) for i in range(20)]
    for i, words_of_item in items:
        for edits in (0, 1, 3, 8):
            copy = list(words_of_item)
            for _ in range(edits):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["new"], ["new", copy[at]]])
            rows.append((100 * (i + 1) + edits, " ".join(some(30) + copy + some(10)).upper()))
        rows.append((100 * (i + 1) + 50, " ".join(words_of_item)))
    return rows, [(i, " ".join(w)) for i, w in items]


def test_equals_all_windows(spark):
    rows, items = planted()
    check(spark, rows, items)


def test_parts_of_the_benchmark(spark):
    rows, items = planted(9)
    check(spark, rows, items, max_keys=100)


def test_odd_rows(spark):
    phrase = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None), (2, ""), (3, " \t"), (4, "short one"), (5, "Short\tONE\nmore"), (6, phrase), (6, phrase), (None, f"x {phrase}"), (7, "a " * 3000),
            (8, "a a a a a a a a"), (9, "word"), (10, f"{phrase} {phrase}")]
    items = [(1, "short one"), (2, phrase), (3, None), (4, ""), (5, "a a a a a a a"), (5, "a a a a a a a"), (6, "word"), (7, "nowhere at all to be found here")]
    check(spark, rows, items)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b c")])
    check(spark, [(1, "a b c")], [])


def test_blocks_guarantee_the_radius(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        left = rng.getrandbits(63)
        right = left
        for bit in rng.sample(range(63), rng.randrange(D.RADIUS + 1)):
            right ^= 1 << bit
        pairs.append((left, right))
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("n", F.lit(20))
    keys = lambda c: D.block_keys(F.col(c), F.col("n"))
    meeting = D._first_meeting(F.col("a"), F.col("b"), F.col("n"))
    out = df.select(meeting.alias("m"), F.array_contains(keys("a"), meeting).alias("in_a"), F.array_contains(keys("b"), meeting).alias("in_b")).collect()
    assert all(r["m"] is not None and r["in_a"] and r["in_b"] for r in out)


def test_native_plan_without_cross_join(spark):
    rows, items = planted()
    plan = D.contaminated(*frames(spark, rows, items))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("CartesianProduct", "NestedLoop", "Python", "Pandas", "Arrow"))
