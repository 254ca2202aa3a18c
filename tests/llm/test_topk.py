import math
import random

import pytest
from pyspark.sql import functions as F

from defectlens.llm import topk

SCHEMA = "vec_id long, embedding array<float>, id long, v string, tile string"


def brute(rows, k=5, step=2):
    top, low = 2**63 - 1, -(2**63)
    whole = lambda x: max(low, min(top, math.floor(256 * x)))
    usable = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if i % step == 0:
            scores = [(-max(low + 1, min(top, sum(a * b for a, b in zip(q, v)))), j) for j, v in usable if j != i and len(v) == len(q)]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def check(spark, rows, **settings):
    rows = [(i, None if v is None else [None if x is None else float(spark_float(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, "x", "x") for i, v in rows], SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 2 == 0, **settings)
    assert sorted(map(tuple, got.collect())) == brute(rows, settings.get("k", 5))


def spark_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("settings", [{}, {"tile": 4, "shard": 7, "fan": 2}, {"tile": 1000, "shard": 3, "fan": 3, "k": 2}])
def test_equals_plain_python(spark, settings):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(60)]
    rows += [(100 + i, [0.5] * 8) for i in range(30)]  # ties
    check(spark, rows, **settings)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [float("nan"), 1.0]), (2, None), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [1.0]), (7, [0.1, 0.2]),
            (None, [1.0, 1.0]), (8, [1e30, 1e30]), (9, [-1e30, 3.0]), (10, [1.0, 2.0]), (10, [3.0, 1.0])]
    check(spark, rows)


def test_none_and_one(spark):
    check(spark, [])
    check(spark, [(2, [1.0])])
    check(spark, [(2, [1.0]), (2, [2.0])])


def test_cells_are_bounded(spark):
    """A cell of the grid holds about a tile and a shard, however large the table."""
    df = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5)).alias("embedding"))
    assert topk.top_k(df, F.col("vec_id") % 50 == 0, tile=20, shard=500, fan=4).count() == 500
