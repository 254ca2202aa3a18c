import hashlib
import random

import pytest
from pyspark.sql import functions as F

from defectlens.llm import prefix_trie

TURNS = "conv_id long, turns array<struct<role string, text string>>, depth string, ids string, key string"


def brute(talks):
    """{prefix: (conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved, ends)}"""
    talks = [(c, tuple((r or "", x or "") for r, x in turns or [])) for c, turns in talks]
    members = {}
    for c, turns in talks:
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append((c, len(turns) == d))
    least = {k: min((c for c, _ in m if c is not None), default=None) for k, m in members.items()}
    children = {k: 0 for k in members}
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join("" if c is None else str(c) for c in sorted((c for c, end in m if end), key=lambda c: (c is not None, c)))
        out.append((len(k), least[k], least[k[:-1]] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, talks, **options):
    df = spark.createDataFrame([(c, t, "clash", "clash", "clash") for c, t in talks], TURNS)
    trie = prefix_trie.prefix_trie(df, **options).select("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r) for r in trie.collect()), key=str)


def sample(seed, n, deepest):
    rng = random.Random(seed)
    talks, said = [], [[]]
    for c in range(n):
        start = rng.choice(said)
        turns = start[: rng.randrange(len(start) + 1)] + [(rng.choice(["u", "a", None]), rng.choice(["é", "x" * 9, "", None, "b"])) for _ in range(rng.randrange(deepest))]
        said.append(turns)
        talks.append((c * 3, turns))
    return talks


@pytest.mark.parametrize("options", [{}, {"levels": 1}, {"levels": 2, "task_turns": 20}, {"levels": 1, "task_turns": 3}])
def test_against_brute_force(spark, options):
    talks = sample(7, 150, 7)
    assert run(spark, talks, **options) == brute(talks)


def test_long_hot_and_odd_conversations(spark):
    long = [("u", str(i)) for i in range(300)]
    talks = [(c, long[:200] + [("a", str(c))]) for c in range(4)] + [(10, long), (11, long), (12, long[:8]), (13, long[:9])]
    talks += [(c, [("u", "hot")]) for c in range(100, 400)] + [(c, [("u", "hot"), ("a", str(c))]) for c in range(400, 500)]
    talks += [(None, [("u", "hot")]), (None, [("u", "alone")]), (500, None), (501, []), (502, [("", "")]), (503, [(None, None)]), (504, [("u", "y" * 300_000)])]
    talks += [(600, [("a", "bc")]), (601, [("ab", "c")]), (602, [("a", "b"), ("c", "")])]  # the same characters, other turns
    assert run(spark, talks) == brute(talks)


def test_peels_one_group_in_memory():
    row = lambda c, path: {"depth": len(path), "ids": [path[: i + 1].encode() for i in range(len(path))], "sizes": [1] * len(path), "conv_id": c, "n_convs": 1,
                           "n_children": 0, "n_leaves": 0, "saved": 0, "ends": str(c)}
    nodes, rest = prefix_trie.peel([row(1, "abc"), row(2, "abd"), row(3, "ab")], 1)
    assert sorted((n["depth"], n["key"], n["n_convs"], n["n_children"], n["n_leaves"], n["saved"], n["ends"]) for n in nodes) == [
        (2, b"ab", 3, 2, 2, 2, "3"), (3, b"abc", 1, 0, 1, 0, "1"), (3, b"abd", 1, 0, 1, 0, "2")]
    assert (rest["depth"], rest["n_convs"], rest["n_children"], rest["n_leaves"], rest["saved"]) == (1, 3, 1, 2, 2)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_conversations_in_order(spark):
    rows = [(1, 1, "b", "x"), (1, None, None, None), (1, 0, "a", "y"), (1, 0, "a", "w"), (None, 0, "u", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in prefix_trie.conversations(df).collect()}
    assert got == {1: [("", ""), ("a", "w"), ("a", "y"), ("b", "x")], None: [("u", "z")]}
