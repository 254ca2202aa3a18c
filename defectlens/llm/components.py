"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from defectlens.llm.common import cut


def _summary(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")
    ).first()
    return row["n"], row["digest"]


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``links`` (u long, v long) to (node, root): each linked node with the smallest node of its component.

    Alternates large-star and small-star rounds until no link changes: every node hands its neighbours to its smallest
    one. The number of links never grows, a round shuffles them twice, and nothing but two numbers a round
    reaches the driver. Self links, repeated links and links with a null end are ignored; no link gives no row.
    """
    pairs = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = cut(pairs)
    before = _summary(pairs)
    for _ in range(max_rounds):
        pairs = cut(_small_star(_large_star(pairs)))
        after = _summary(pairs)
        if after == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                pairs.select(F.col("v"), F.col("v")).distinct()
            )
        before = after
    raise RuntimeError(f"components not found in {max_rounds} rounds")


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of the node and its neighbours."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all move to the smallest of these."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()
