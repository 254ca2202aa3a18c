import itertools
import random

import pytest
from pyspark.sql import functions as F

from defectlens.llm import simhash
from defectlens.llm.components import connected_components
from helpers import components, simhash as plain, simhash_components

SCHEMA = "doc_id long, text string, id string, fingerprint string, root string, _key string, _id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)


def near_copies(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(50)]
    base = [rng.choice(words) for _ in range(300)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(i % 4):
            text[rng.randrange(300)] = rng.choice(words)
        out.append((i, " ".join(text)))
    return out


def test_masks_cover_the_radius():
    near, far = simhash.near_masks(), simhash.far_masks()
    assert len(set(near)) == 65 and len(set(far)) == 2 * 32 * 31 // 2
    as_bits = {frozenset(b for b in range(64) if m >> b & 1) for m in far}
    rng = random.Random(3)
    for _ in range(2000):
        three = rng.sample(range(64), 3)
        assert any(frozenset(pair) in as_bits for pair in itertools.combinations(three, 2))


def test_fingerprint_in_blocks():
    text = " ".join(f"word{i % 97}" for i in range(3000)) + "  \t end"
    for block in (1, 7, 100, 1 << 20):
        assert simhash.fingerprint(text, block=block) == plain(text)
    for text in (None, "", " \t\n", "One", "one TWO", "a b c", "É é x"):
        assert simhash.fingerprint(text) == plain(text)
        assert simhash.fingerprint(text, width=1, block=2) == plain(text, 1)


def test_equals_all_pairs(spark):
    rows = near_copies(60) + [(100 + i, t) for i, t in enumerate([None, "", " \n", "lone", "lone", "two words", "Two Words", "x y z", "x" * 5000])]
    rows += [(200 + i, f"entirely different text number {i} of its own {i * i} kind") for i in range(40)]
    prints, roots = simhash_components(rows)
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["id"]: r["fingerprint"] & (1 << 64) - 1 for r in got} == prints
    assert {r["id"]: r["component_id"] for r in got} == roots
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots.values()))


def test_links_are_exact_for_planted_distances(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    flip = lambda *bits: base ^ sum(1 << b for b in bits)
    values = [base, flip(0), flip(63), flip(5, 40), flip(1, 2, 33), flip(31, 32, 63), flip(10, 11, 12, 13, 50, 51)]
    values += [rng.getrandbits(64) for _ in range(200)]
    values = list(dict.fromkeys(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), len(values)).collect()
    found = components([(r["u"], r["v"]) for r in links], signed)
    want = components([(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3], signed)
    assert found == want
    assert all(1 <= ((r["u"] ^ r["v"]) & (1 << 64) - 1).bit_count() <= 3 for r in links)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (3, "quite another text"), (None, "only null ids here")]
    got = simhash.near_duplicates(frame(spark, rows))
    assert sorted((r["id"] is None, r["id"] or 0, r["component_id"]) for r in got.collect() if r["component_id"] is not None) == [
        (False, 3, 3), (False, 3, 3), (False, 3, 3), (True, 0, 3), (True, 0, 3)]
    assert sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(frame(spark, rows)).collect()), key=str) == sorted(
        [(3, "a b c d"), (3, "quite another text"), (None, "only null ids here")], key=str)
    assert simhash.keep_one(frame(spark, [])).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 50), (50, 51)]])
def test_connected_components(spark, links):
    df = spark.createDataFrame(links, "u long, v long")
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == components(real, {n for pair in real for n in pair})


def test_no_task_meets_a_whole_group(spark):
    """A star of every variant is the only thing that groups; its size is bounded by the ball, not by the group."""
    df = spark.range(100).select(F.xxhash64("id").alias("fp"))
    plan = simhash.fingerprint_links(df, 100)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "collect_" not in plan
