"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step replaces every node's links by links to its smallest neighbour, through an aggregate and a join (both
can be split where one node has many links), and is cut by a checkpoint; the number of steps grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u > v) to links again. large: larger neighbours to the smallest; small: smaller ones to the smallest."""
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select("u", "v")
    # cut, so that the join reads two plain exchanges (or broadcasts) and a node of many links can be split over tasks
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (columns u, v of one orderable type); root is the smallest reachable node.

    Links of a node to itself, repeated ones and either direction are fine. Roots map to themselves.
    """
    now = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    digest = None
    while True:
        now = cut(_star(_star(now, True), False))
        found = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (found.n, found.x) == digest:
            break
        digest = (found.n, found.x)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
