"""Connected components of an edge table by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = _symmetric(edges)
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is tied to the smallest neighbour."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return tied.unionByName(own).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node with an edge; root is the smallest node reachable. ``edges`` has long columns
    a and b. Each round is written out, so a lost executor costs one round. Minima combine before the shuffle,
    and joins on a hub node have one row on the other side, so Spark can split them."""
    current = written(edges.filter("a <> b").distinct())
    known = None
    while True:
        current = written(_small_star(_large_star(current)))
        # A sum of hashes tells equal edge sets; the stars end in a fixed point.
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if tuple(now) == known:
            break
        known = tuple(now)
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = leaves.select(F.col("root").alias("node"), "root").distinct()
    return leaves.unionByName(roots)
