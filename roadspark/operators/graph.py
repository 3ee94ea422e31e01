"""Weakly connected components of a road graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadspark.functions.tables import stored


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` of all ``nodes`` (node): the least node that ``edges`` (from_node, to_node) reach either way.

    Star contraction: each round hangs every node's neighbours on its least one, first the greater ones, then all
    smaller ones, so long roads take about as many rounds as the logarithm of their length.  Only a count and a
    checksum come to the driver.
    """
    now = edges.select(F.greatest("from_node", "to_node").alias("u"), F.least("from_node", "to_node").alias("v")).where("u <> v").distinct()
    now, mark = stored(now, "edges"), None
    for _ in range(rounds):
        turned = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = turned.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = turned.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.select("node").join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_summary(found: DataFrame) -> DataFrame:
    """One row: (components, largest)."""
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
