"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.store import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) for every node of the links (a, b); comp is the smallest node reachable.

    Sizes are aggregated before every join and no neighbour list is ever gathered, so a
    node with very many links costs rows, not memory. Each round is written to the shared
    folder. The rounds end when a round leaves the links as they were.
    """
    state = scratch.save(edges.select("a", "b").where("a <> b").distinct(), f"{name}-0")
    before, k = None, 0
    while True:
        k += 1
        new = scratch.save(_small_star(_large_star(state)).distinct(), f"{name}-{k}")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{k - 1}")
        state = new
        if now == before:
            break
        before = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("comp"))
