"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations with map-side minima and two joins, so a node with very
many neighbours is a hot join key that adaptive execution splits, and nothing is
gathered on the driver.  The number of rounds grows with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import cut, drop


def _large(edges: DataFrame, name: str, made: list[DataFrame]) -> DataFrame:
    """Connects each node's larger neighbours to its smallest one.

    The minima are written first: a join of two plain exchanges is one that adaptive
    execution can split at a hot node.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}-least")
    made.append(least)
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame, name: str, made: list[DataFrame]) -> DataFrame:
    """Connects each node's smaller neighbours, and itself, to its smallest one (edges run from large to small)."""
    least = cut(edges.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
    made.append(least)
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``; the root is the component's smallest node."""
    directed = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(directed, f"{name}-0")
    before, at, old = _state(now), 0, [now]
    while before[0]:
        at += 1
        large = cut(_large(now, f"{name}-{at}a", old), f"{name}-{at}a")
        now = cut(_small(large, f"{name}-{at}b", old), f"{name}-{at}b")
        old.append(large)
        after = _state(now)
        drop(*old)
        old = [now]
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
