"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every node's greater neighbours go to the least of its closed
    neighbourhood. Small: every node and its lesser neighbours do."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, area, name: str) -> DataFrame:
    """node and component (its least node) of every node of the undirected
    edges (u, v). Edges are written to the work area after every step, which
    cuts the lineage; the loop ends when the edges are stars."""
    edges = area.write(edges.select("u", "v").filter("u <> v"), f"{name}-0")
    step = 0
    while True:
        step += 1
        edges = area.write(_star(_star(edges, True), False), f"{name}-{step}")
        # every edge leads from a leaf to a root, and every leaf to one: nothing would change
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
        if ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).filter("leaf + root > 1").isEmpty():
            break
    leaves = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
