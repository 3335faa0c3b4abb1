"""Connected components of an edge table, by alternating star rewriting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import scratch, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("b", "a")).toDF("u", "v")


def _star(near: DataFrame, large: bool) -> DataFrame:
    """Link every node's larger (or, with itself, smaller) neighbours to its smallest neighbour."""
    pairs = _both(near) if large else near.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = pairs.join(least, "u")
    out = met.filter("v > u").select("v", "m") if large else met.select("v", "m").union(least)
    return out.filter("v <> m").distinct().toDF("a", "b")


def connected_components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has an edge.

    edges: two columns of comparable ids. Rounds grow with the logarithm of the number of nodes; each one's
    edges are written to the shared folder until the last, so lost executors cost one round at most. keep writes the result.
    """
    with scratch(edges.sparkSession) as own:
        near = own(edges.toDF("a", "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        state = None
        while True:
            near = own(_star(_star(near, True), False))
            now = near.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == state:
                break
            state = now
        # each edge now joins a node to its component's smallest
        return keep(near.select(F.col("a").alias("node"), F.col("b").alias("component")).union(near.select("b", "b").distinct()))
