"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum and an equality join, both on one endpoint; a hub's
links are combined before the shuffle or split by adaptive execution. Each round is
written to the shared folder, so a lost executor costs one round at most. Nothing is
collected but a count and a checksum that tell when links stop changing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    tied = both.join(least, "a").where(F.col("b") > F.col("a"))
    return tied.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Needs a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(others).distinct()


def _state(links: DataFrame) -> tuple:
    check = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    return tuple(links.agg(F.count("*"), check).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a table of links (a, b): the root is the smallest
    node reachable. Loops and repeated links are allowed; no links give no rows."""
    start = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = materialize(start.distinct(), "links")
    state = _state(current)
    while state[0]:
        following = materialize(_small_star(_large_star(current)), "links")
        reached = _state(following)
        current = following
        if reached == state:
            break
        state = reached
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
