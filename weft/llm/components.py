"""Connected components of an edge table, distributed: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node it can reach.

    Each round joins every node to the smallest of its neighbours: large-star
    moves larger neighbours there, small-star the rest. The number of rounds
    grows with the logarithm of the longest path. Minima are partially
    aggregated, neighbour lists are never gathered, and every round is a written
    table, so a lost executor costs one round at most. Null edges are ignored.
    """
    a, b = F.col("a"), F.col("b")
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    pairs = materialize(pairs, "edges")
    total = None
    for _ in range(most_rounds):
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        star = materialize(star, "star")
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        joined = star.join(low, "a")
        new = joined.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        new = materialize(new, "round")
        # stable when every node has one edge and no root of one is a node of another
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        discard(pairs)
        discard(star)
        pairs = new
        if total == (state["n"], state["s"]):
            break
        total = (state["n"], state["s"])
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
