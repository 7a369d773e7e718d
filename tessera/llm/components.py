"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a join on a node and its least neighbour, found by a partial aggregate, so a node
with very many edges is spread by Spark's skew handling; edges never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage, unstage


def _star(edges: DataFrame, least: DataFrame, larger: bool) -> DataFrame:
    joined = edges.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for all nodes of edges(src long, dst long)."""
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    pairs = stage(pairs)
    before = None
    while True:
        # large star: each node's larger neighbours move to the least node around it
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _star(both, least, True).where("u <> v").distinct()
        # small star: each node and its smaller neighbours move to the least of these
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(large, lower, False).unionByName(lower.select("u", F.col("m").alias("v")))
        last, pairs = pairs, stage(small.where("u <> v").distinct())
        unstage(last)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
