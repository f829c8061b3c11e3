"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour (or itself) to its larger neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "lows")  # so that a join on a node with very many edges can be split
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours and itself to the smallest of them. Edges have a > b."""
    low = stage(edges.groupBy("a").agg(F.min("b").alias("low")), "lows")
    joined = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
    return joined.union(low.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)``; the component is its smallest node.

    Rounds end when a step changes nothing (logarithmic in the longest chain). Each round is
    written to the shared folder, so a lost executor costs one round. Self loops, repeated
    edges and an empty table are fine; edges with a null end are ignored.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = None
    for _ in range(MOST_ROUNDS):
        row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")).first()
        if tuple(row) == digest or row[0] == row[2] and not now.join(now.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            break
        digest = tuple(row)
        now = stage(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("low")), "node", "left").select("node", F.coalesce("low", "node").alias("component"))
