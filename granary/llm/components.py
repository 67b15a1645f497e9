"""Connected components by alternating star contraction, as joins over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import discard, written


def _stars(links: DataFrame) -> DataFrame:
    """One round: every node hands its larger, then its smaller neighbours to the least node it knows."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")  # at most a row a link, repeated ones too
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether the distinct links (a, b) are stars: no node is linked to two lesser ones, or to a lesser and a larger one.

    It takes one sum by node, where one more round that changes nothing would take five shuffles.
    """
    ends = links.select("a", F.lit(1).alias("_down")).unionByName(links.select(F.col("b").alias("a"), F.lit(0).alias("_down")))
    each = ends.groupBy("a").agg(F.sum("_down").alias("_down"), F.count("*").alias("_n"))
    return not each.where("_down > 1 OR (_down = 1 AND _n > 1)").count()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is the least node reachable.

    Links are undirected, may repeat and may join a node to itself; links with a null end are ignored.
    A round takes a logarithmic share of the longest path, and each is written to the shared folder; links that are
    stars already take none. Without any link the result is empty.
    """
    now = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x != y")
    now = written(now.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    while not _settled(now):
        after = written(_stars(now))
        discard(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
