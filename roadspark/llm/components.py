"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: hang each node's greater neighbours (large), or all smaller ones and itself (small), on its least.

    The ends are dealt out by ``u`` once; both the least neighbours and the join with them work on that.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if large:
        both = both.select("u", "v").unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = both.repartition("u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u")
    if large:
        return out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    hung = out.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` of each node of the undirected ``edges`` (u, v); the component is its least node.

    The number of rounds is about the logarithm of the longest path.  Each round is written to the shared
    folder; only a count and a checksum come to the driver.  Self-loops and repeated edges do no harm, null ends
    are left out.
    """
    now = stored(edges.where("u <> v").select("u", "v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        now = stored(_stars(_stars(now, large=True), large=False), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
