"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import saved, with_values


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node reachable.

    Alternates two kinds of star until nothing changes: every node sends its
    larger neighbours to the smallest node it knows, then does so for the
    smaller ones. The rounds needed grow with the logarithm of the longest
    path. Every round is written to the shared folder, so lineage stays short
    and a lost executor costs no earlier round; nothing but one count of
    changed links reaches the driver. A hub's links meet in an aggregate that
    combines before the shuffle (the smallest neighbour), and hubs with a share
    of all links are joined by broadcast, of which there is a bounded number.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    total, before = 2 * edges.count(), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # large star: neighbours over the node go to its smallest
        large = with_values(both, least, "a", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: the smaller neighbours, and the node itself, go to the smallest
        large = saved(large.distinct(), "links")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = with_values(large, lowest, "a", total).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = saved(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if before == tuple(now):
            break
        total, before = 2 * now[0], tuple(now)
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
