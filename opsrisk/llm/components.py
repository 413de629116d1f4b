"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the least of the node's neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the least node of its component.

    Each round is two aggregates with map-side combining and two joins by node; edges never grow in number beyond a
    small multiple, and a node with very many neighbours is a skewed join key that AQE splits, never a gathered group.
    The number of rounds grows with the logarithm of the longest chain.
    """
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    now = state(edges)
    while now[0]:
        nxt = _small_star(_large_star(edges)).where("a <> b").distinct()
        edges, before = saved(nxt, name), now
        now = state(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
