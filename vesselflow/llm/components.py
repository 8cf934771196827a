"""Connected components of a table of links, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselflow.llm.common import stored

#: More rounds than any graph needs: each pair of them at least halves its longest paths.
MOST_ROUNDS = 60


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour (or itself)."""
    ways = _both_ways(links)
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = ways.where("b > a").join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b), roots excluded; the root is the least node.

    Links from a node to itself do not count, repeated ones count once, and so does a link
    stated in both directions. Large-star and small-star rounds alternate until nothing
    moves. Each round is written to the shared folder. Nodes with very many links are
    ordinary rows of joins, whose partitions Spark splits, and minima are taken before the
    shuffle.
    """
    current = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    for _ in range(MOST_ROUNDS):
        current = stored(_small_star(_large_star(current)), "links")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
