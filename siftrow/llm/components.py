"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftrow.llm.common import stored


def connected_components(links: DataFrame, folder: str) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has a link. links: a, b (longs), any order.

    Each round first links every node's larger neighbours to its smallest one, then every node's smaller neighbours. Minima
    are aggregated before they move, and a node with very many links is split by the join. Rounds are written to `folder`.
    Links of a node with itself, repeated links and links with a null end change nothing.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, f"{folder}/edges-0")
    turn = 0
    signature = None
    while True:
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        # Every smaller neighbour, and the node itself, is linked to the node's smallest neighbour.
        moved = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = stored(moved.where("a <> b").distinct(), f"{folder}/edges-{turn}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == signature:
            break
        signature = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
