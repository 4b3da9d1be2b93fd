"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleanframe.llm.common import written

#: Rounds grow with the logarithm of the longest chain; beyond this something is wrong.
MOST_ROUNDS = 60


def _both_ways(links: DataFrame) -> DataFrame:
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.unionByName(turned)


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node's neighbours."""
    pairs = _both_ways(links)
    return pairs.where("b > a").join(_smallest(pairs), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _smallest(pairs)
    moved = pairs.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)`` but the roots; root is the smallest node.

    Every step is a grouped minimum with partial aggregation and a join on the node, so a node with very
    many links is aggregated before the shuffle. Each round is written to the shared folder: plans
    stay short and lost executors cost one round at most. No link leaves the tasks; the driver sees a
    count and a checksum for each round.
    """
    tidy = lambda x: x.where("a != b").distinct()
    links, before = written(tidy(links.select("a", "b")), "links"), None
    for _ in range(MOST_ROUNDS):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        links = written(tidy(_small_star(tidy(_large_star(links)))), "links")
    raise RuntimeError(f"no stable components after {MOST_ROUNDS} rounds")
