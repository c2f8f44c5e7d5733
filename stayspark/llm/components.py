"""Connected components of a graph given as links, by alternating large and small stars.

Every node is linked to the smallest node in sight, in turn over all its neighbours and over its
smaller ones, until each component is a star around its smallest node.  A round is a few shuffles
of the links; the rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayspark.session import durable


# Parts that the links of a node are folded in before they meet: a star's centre may have any number.
PARTS = 64


def _least(links: DataFrame) -> DataFrame:
    """``a`` and ``m``, the smallest of its ``b``.

    Folding inside the map tasks leaves a row per task and node, so a star's centre would bring one
    task as many rows as there are tasks.  Folding by a part of the other end first spreads those.
    """
    part = F.pmod(F.xxhash64("b"), F.lit(PARTS)).alias("part")
    parts = links.groupBy("a", part).agg(F.min("b").alias("m"))
    return parts.groupBy("a").agg(F.min("m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = _least(both)
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    other = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(other)


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (two columns) that is not the smallest of its component.

    ``root`` is that smallest node.  Links may repeat and lead either way; links of a node to
    itself, and those with a null end, say nothing.
    """
    links = durable(links.toDF("a", "b").where("a <> b").distinct())

    def state(frame: DataFrame):
        return frame.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        ).first()

    before = state(links)
    while before[0]:
        links = durable(_small_star(_large_star(links)).where("a <> b").distinct())
        after = state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
