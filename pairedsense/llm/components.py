"""Connected components of a link table by alternating stars.

Every round hangs each node's larger neighbours, then its smaller ones, under
its least neighbour; the tables of a round are read from the shared folder, so
a lost executor costs one round. A node with very many neighbours is combined
before the shuffle (a minimum) and its links are dealt by AQE's skew join. What
comes to the driver is one number per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _star(edges: DataFrame) -> DataFrame:
    """One round: links (u, v) to links (node, least neighbour)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u")
    small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return small.distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): component is the least node reachable; nodes without a link to another are left out.

    NULL ends and links of a node to itself say nothing and are left out.
    """
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b")
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        edges = stage(_star(edges), "stars")
        # Done when every node hangs under a node that hangs under none, and nothing moved.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now
