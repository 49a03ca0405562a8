"""Connected components by alternating large-star and small-star (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm._common import Scratch


def _beside(rows: DataFrame, least: DataFrame) -> DataFrame:
    """Joins the minimum of its node to each link.  The key is the node in another form, so both sides are dealt out for
    this join and the links of a hub can be split; a partitioning taken over from the aggregate could not be."""
    key = F.col("u").bitwiseXOR(F.lit(1))
    return rows.join(least.select(key.alias("k"), "m").hint("merge"), key == F.col("k")).drop("k")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _beside(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _beside(down, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Each node has one link down at most, and none where a link ends: nothing is left to do."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("n")).where("down > 1 OR (down = 1 AND n > 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """``node, component`` of all nodes that have a link; the component is its smallest node.

    ``edges``: columns u and v (long, not null; loops and repeated links are allowed).  Minima are aggregated before any
    join, each round is staged, and only whether the links are stars comes to the driver.
    """
    now = scratch.stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    for k in range(1, rounds + 1):  # star rounds grow with the logarithm of the nodes
        if _stars(now):
            break
        now = scratch.stage(_small_star(_large_star(now)).distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
