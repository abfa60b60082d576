"""Connected components of a distributed edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, written


def _stars(edges: DataFrame) -> bool:
    """Whether every node that is a larger end is so once, and never a smaller one."""
    twice = edges.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return not twice and not edges.select(F.col("u").alias("v")).distinct().join(edges, "v", "left_semi").limit(1).count()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) edges of any one orderable type -> (node, root), root the smallest node of the component.

    Large-star / small-star: each round hangs every node's larger neighbours on the smallest one, then does
    so for the smaller neighbours; both are a grouped minimum (combined before the shuffle) and a join. The
    loop ends when the edges are stars, after a number of rounds that grows with the logarithm of the longest
    chain; more than ``most_rounds`` are an error. Each round is written to the shared folder, the one before
    deleted. Nodes without an edge don't appear. Loops and repeated edges are allowed, null ends are not; an
    empty table gives an empty table.
    """
    edges = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc")
    rounds = 0
    while not _stars(edges):
        rounds += 1
        if rounds > most_rounds:
            raise RuntimeError(f"no components after {most_rounds} rounds")
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        # small star: each node with its smaller neighbours
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        nxt = written(small.select(F.col("m").alias("u"), "v").union(small.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct(), "cc")
        discard(edges)
        edges = nxt
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
