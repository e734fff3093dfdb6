"""Connected components of a table of links, by alternating stars, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, freeing, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(least, "u")
    return near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one node, which hangs on none: then nothing is left to do."""
    with freeing(edges.sparkSession):
        return edges.groupBy("u").count().where("count > 1").isEmpty() and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of the nodes of links (a, b) other than components' least nodes.

    Each round writes a table, so a lost executor costs one round at most. The number
    of rounds grows with the logarithm of the number of nodes.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_stars(edges):
        following = materialise(_small_star(_large_star(edges)), "edges")
        discard(edges)
        edges = following
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._recordflow_path = edges._recordflow_path
    return out
