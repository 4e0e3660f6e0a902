"""Connected components of links, by alternating large and small stars: a few joins, however long the chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v), u > v: a node's neighbours are linked to the smallest of them and itself instead."""
    if large:
        near = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    else:
        near = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    least = near.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("x2"), F.least("x", "m").alias("m"))
    joined = near.join(least, F.col("x") == F.col("x2"))
    if large:
        new = joined.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.where("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x2").alias("u"), F.col("m").alias("v")))
    return new.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b), two integers each: component is the smallest node reachable.

    Loops, repeated edges and both directions are allowed; no edges give no rows. A node with a third of all edges is
    no task of its own: joins on it are split, and minima are taken before the shuffle.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    check = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = None
    while True:
        edges = cut(_stars(_stars(edges, large=True), large=False))
        now = edges.agg(F.count(F.lit(1)), check).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
