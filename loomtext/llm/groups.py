"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import cut


def components(edges: DataFrame, folder: str = "") -> DataFrame:
    """(node, root): the least node that edges (a, b) lead to, for every end of an edge.

    Alternates large-star and small-star steps until the sum of the edges stops
    changing; the number of rounds grows as the logarithm of the longest path.
    A step takes the least neighbour of each node and joins it to the node's
    edges, so no node's neighbours are ever gathered in one place. Each round's
    edges are a written table. Nodes may be of any type with an order.
    """
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("low", "a").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        met = large.join(lowest, "a")
        small = met.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(lowest)
        edges = cut(small.distinct(), "component-edges", folder)
        summed = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if summed == state or summed[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = summed
