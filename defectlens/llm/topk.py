"""Exact top-k search by inner product: tiles of queries times shards of candidates, merged as a tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from defectlens.llm.common import cut

TILE, SHARD, FAN = 512, 16_384, 32  # queries a tile, candidates a shard, lists merged at once
EXACT = 2**53  # integers that float64 holds exactly
LONG = np.iinfo(np.int64)
RESULT = "query_row long, query_id long, shard int, vec_id long, score long"


def whole_components(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component; null where the vector or a component is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(len(column), dim)


def best_of_shard(queries: np.ndarray, own: np.ndarray, shard: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple]:
    """Per query with a candidate: its position, and ids and scores of its k best of the shard, ties to the smaller id; candidates with the query's own id are left out."""
    order = np.argsort(ids, kind="stable")
    shard, ids = shard[order], ids[order]
    reach = sum(float(np.abs(queries[:, i]).max()) * float(np.abs(shard[:, i]).max()) for i in range(shard.shape[1]))
    if reach < EXACT // 2:
        scores = (queries.astype(np.float64) @ shard.T.astype(np.float64)).astype(np.int64)
    else:  # huge components: exact integers, then held to the range of a long
        exact = queries.astype(object) @ shard.T.astype(object)
        scores = np.clip(exact, LONG.min + 1, LONG.max).astype(np.int64)
    for query, (row, query_id) in enumerate(zip(scores, own)):
        left, right = np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, side="right")
        usable = len(ids) - (right - left)
        if not usable:
            continue
        row[left:right] = LONG.min
        if usable > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            above, equal = np.flatnonzero(row > least), np.flatnonzero(row == least)
            picked = np.concatenate((above, equal[: k - len(above)]))  # equal scores: ids ascend with the position
        else:
            picked = np.flatnonzero(np.r_[np.ones(left, bool), np.zeros(right - left, bool), np.ones(len(ids) - right, bool)])
        yield query, ids[picked], row[picked]


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
    tile: int = TILE, shard: int = SHARD, fan: int = FAN,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other vectors for each row with ``is_query``.

    Components become floor(256 x), held to the range of a long. Vectors that are null, hold null or non-finite components, or
    have no id take no part, and vectors meet those of their own length only. Rows of a query's own id are not its candidates;
    repeated rows are candidates each, and a repeated query gets its list each time. Fewer candidates than k give shorter
    lists, none gives no row. Other columns are ignored.

    Rows are dealt evenly to tiles and shards. Each cell of the grid is one group of at most about a tile and a shard,
    whatever the size of the table, and each level of the merge takes at most ``fan`` lists of a query.
    """
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"), whole_components(F.col(embedding)).alias("v"), is_query.alias("q"),
        F.monotonically_increasing_id().alias("row"),
    ).where("v is not null and id is not null").withColumn("dim", F.size("v"))
    rows = cut(rows.where("dim > 0"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    tiles, shards = max(1, math.ceil(sizes["q"] / tile)), max(1, math.ceil(sizes["n"] / shard))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    asked = rows.where("q").select(
        deal(tiles).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.lit(True).alias("q"), "id", "row", "v"
    )
    given = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), deal(shards).alias("shard"), "dim", F.lit(False).alias("q"), "id", "row", "v"
    )

    def cell(key: tuple, table: pa.Table) -> pa.Table:
        dim, is_q = key[2].as_py(), table.column("q")
        ask, give = table.filter(is_q), table.filter(pc.invert(is_q))
        out: list[tuple] = []
        if len(ask) and len(give):
            own, number, ids = (c.to_numpy() for c in (ask.column("id"), ask.column("row"), give.column("id")))
            found = best_of_shard(_matrix(ask.column("v"), dim), own, _matrix(give.column("v"), dim), ids, k)
            out = [(number[query], own[query], *lists) for query, *lists in found]
        lengths = [len(x[2]) for x in out]
        join = lambda i: np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64)
        return pa.table({
            "query_row": np.repeat(np.array([x[0] for x in out], np.int64), lengths),
            "query_id": np.repeat(np.array([x[1] for x in out], np.int64), lengths),
            "shard": np.full(sum(lengths), key[1].as_py(), np.int32), "vec_id": join(2), "score": join(3),
        })

    found = asked.union(given).groupBy("tile", "shard", "dim").applyInArrow(cell, RESULT)
    while True:  # one level of the tree: up to ``fan`` lists of a query become one
        found = _best(found.withColumn("shard", (F.col("shard") / fan).cast("int")), k)
        shards = math.ceil(shards / fan)
        if shards <= 1:
            return found.select("query_id", "rank", "vec_id", "score")
        found = found.drop("rank")


def _best(lists: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row", "shard").orderBy(F.col("score").desc(), F.col("vec_id"))
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
