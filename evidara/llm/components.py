"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every larger (or smaller, with the node itself) neighbour of a node on the least one around it."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of links (u, v) that is not its own component's smallest.

    Alternating large and small stars (Kiveris et al., 2014) end after about log^2 of the nodes rounds; each
    shuffles the links by node with partial minima, so that a node with many links is no hot spot.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") > F.col("v")).distinct()
    edges, was = materialize(edges, "links"), None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == was or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        was, edges = now, materialize(_star(_star(edges, True), False), "links")
