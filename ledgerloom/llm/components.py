"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_once, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger neighbours (large) or its smaller ones and itself to the least of them."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("size")))
        return join_once(sides.where("v > u"), least, ["u"], "size").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = saved(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")))
    linked = join_once(down, least, ["u"], "size").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge. Edges are (u, v) of longs.

    The edges of a hub with more than one in 10,000 edges don't meet in one task; others meet by their node.
    """
    with Scratch() as run:
        now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        before = None
        while True:
            now = saved(_star(saved(_star(now, True).where("u <> v").distinct()), False).where("u <> v").distinct())
            state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            run.forget(keep=1)
            if state == before:
                break
            before = state
        pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return run.result(pairs.unionByName(pairs.select("component", "component").toDF("node", "component").distinct()))
