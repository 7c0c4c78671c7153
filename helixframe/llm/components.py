"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, release

#: At most so many nodes are joined by broadcast, those of most edges.
HUBS = 2048


def _least_of(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """The edges (a, b) with m of their a. least: a, m, n (edges of a). Nodes of more than 1 / HUBS of the edges, of which there
    are at most HUBS, are joined by broadcast, so that no task meets all edges of a hub."""
    heavy = F.broadcast(least.where(F.col("n") * HUBS > n_edges).select("a", "m"))
    light = least.where(F.col("n") * HUBS <= n_edges).select("a", "m")
    return edges.join(heavy, "a").unionByName(edges.join(heavy, "a", "left_anti").join(light, "a"))


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, component (the least node reachable) for every node of the edges (columns a, b; any order).

    Each round points every node at the least node of its neighbourhood, first for its larger neighbours, then for
    its smaller ones, until the edges stop changing; a node's partial minima are taken before the shuffle. The number
    of edges never grows. Raises if the rounds don't suffice (they grow with the logarithm of the nodes).
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    for _ in range(rounds):
        release(now.sparkSession)
        n = now.count()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _least_of(both.where("b > a"), least, 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a > b").distinct())
        root = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _least_of(large, root, 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        new = cut(small.unionByName(root.select("a", F.col("m").alias("b"))).distinct())
        same = new.join(now, ["a", "b"], "left_anti").isEmpty() and now.join(new, ["a", "b"], "left_anti").isEmpty()
        now = new
        if same:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def local_components(pairs_a, pairs_b, n: int):
    """Least index reachable from each of n indices, for one block's pairs (numpy arrays)."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, pairs_a, label[pairs_b])
        np.minimum.at(low, pairs_b, label[pairs_a])
        low = low[low]
        if (low == label).all():
            return label
        label = low
