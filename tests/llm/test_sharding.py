import math
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pytest

import __spark_entry__ as spec
from defectlens.llm import sharding

SF = "/root/testdata/sf0.001"


def placed(df, shards, **options):
    return [tuple(r) for r in sharding.shuffle_into_shards(df, shards, **options).collect()]


def check_shape(rows, shards):
    """Counts at most one apart and slots without gaps, for rows that end in shard and slot."""
    slots = defaultdict(list)
    for *_, shard, slot in rows:
        slots[shard].append(slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_draws_have_the_exact_distribution():
    rng = np.random.default_rng(3)
    good, bad, draws, n = 9, 14, 8, 40_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
    chance = {k: math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) for k in range(draws + 1)}
    assert sum((seen[k] - n * p) ** 2 / (n * p) for k, p in chance.items()) < 30  # 8 degrees of freedom
    big = [sharding.hypergeometric(rng, 3 * 10**10, 7 * 10**10, 10**8) for _ in range(200)]
    assert abs(np.mean(big) - 3e7) < 6 * math.sqrt(2.1e7 / 200) and 0.5 < np.var(big) / 2.1e7 < 1.6
    assert [sharding.hypergeometric(rng, 5, 0, 3), sharding.hypergeometric(rng, 0, 5, 3), sharding.hypergeometric(rng, 5, 5, 0), sharding.hypergeometric(rng, 5, 5, 10)] == [3, 0, 0, 5]


def test_matrix_keeps_its_margins():
    rng = np.random.default_rng(4)
    for seed in range(30):
        cells = rng.integers(0, 50, 7).tolist()
        cuts = np.sort(rng.integers(0, sum(cells) + 1, 4))
        parts = np.diff([0, *cuts, sum(cells)]).tolist()
        matrix = sharding.communication_matrix(parts, cells, seed)
        assert matrix.sum(1).tolist() == parts and matrix.sum(0).tolist() == cells and (matrix >= 0).all()


def test_rows_follow_the_matrix(spark):
    """Parts cut at the drawn counts, cells permuted: against plain Python on the same hashes."""
    from pyspark.sql import functions as F

    df = spark.range(3000).withColumn("t", F.col("id") % 7)
    values = [F.col("id"), F.col("t")]
    hashes = df.select("id", F.pmod(F.xxhash64(F.lit(9), F.lit("part"), *values), F.lit(12)), *[F.xxhash64(F.lit(9), F.lit(k), *values) for k in ("first", "second")]).collect()
    parts = defaultdict(list)
    for i, part, first, second in hashes:
        parts[part].append((first, second, i))
    layout = sharding.Layout(3000, 4, 3)
    matrix = sharding.communication_matrix([len(parts[p]) for p in range(12)], layout.sizes().ravel().tolist(), 9)
    cells = defaultdict(list)
    for p in range(12):
        rows = iter(sorted(parts[p]))
        for cell, n in enumerate(matrix[p]):
            cells[cell] += [(second, i) for _, second, i in islice(rows, int(n))]
    want = {}
    for cell, rows in cells.items():
        for at, (_, i) in enumerate(sorted(rows)):
            want[i] = (cell // 3, int(layout.starts().ravel()[cell]) + at)
    got = sharding.shuffle_into_shards(df, 4, seed=9, task_rows=250).collect()
    assert {r["id"]: (r["shard"], r["slot"]) for r in got} == want
    check_shape([(r["shard"], r["slot"]) for r in got], 4)


def test_depends_on_rows_and_seed_alone(spark):
    df = spark.range(2000)
    one = set(placed(df, 5, seed=1))
    assert one == set(placed(df.repartition(3), 5, seed=1)) and one != set(placed(df, 5, seed=2))


def test_every_place_is_equally_likely(spark):
    counts, df = np.zeros((4, 4)), spark.range(4).coalesce(1)
    for seed in range(48):
        for i, shard, slot in placed(df, 2, seed=seed, task_rows=2, max_parts=4):
            counts[i, 2 * shard + slot] += 1
    assert ((counts - 12) ** 2 / 12).sum() < 30  # 9 degrees of freedom


@pytest.mark.parametrize("shards", [1, 7, 24, 300])
def test_odd_rows(spark, shards):
    rows = [(None, None, 1), (1, "", 1), (2, "x" * 200_000, 1)] + [(3, "same", 5)] * 90 + [(i, "copy", 2) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = placed(df, shards, task_rows=30)
    check_shape(out, shards)
    assert Counter((i, t) for i, t, *_ in out) == Counter((i, t) for i, t, _ in rows)


def test_columns_of_any_kind_and_name(spark):
    df = spark.sql("SELECT id, map('a', id) AS m, array(id) AS `a``b.c`, id AS _part, id AS _rank FROM range(50)")
    out = sharding.shuffle_into_shards(df, 4)
    assert out.columns == ["id", "m", "a`b.c", "_part", "_rank", "shard", "slot"] and all(r["id"] == r["_part"] for r in out.collect())


def test_empty_table(spark):
    out = sharding.shuffle_into_shards(spark.range(0), 4)
    assert out.columns == ["id", "shard", "slot"] and out.count() == 0


def test_query(spark):
    import zlib

    got = spec.queries()["op12_sharding"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)} and len(got) == len(texts)
    check_shape([(r["shard"], r["slot"]) for r in got], 24)
