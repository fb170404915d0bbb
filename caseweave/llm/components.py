"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


class Forest:
    """Smallest reachable node of each node."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            if (x == y).all():
                return
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``links`` (columns ``a, b``).

    Each round ties every larger neighbour of a node to the smallest one, then every smaller
    neighbour; the number of rounds grows with the logarithm of the longest path.  Rounds are
    written to the shared folder.  Neighbourhoods are only reduced to their smallest member, so a
    hub costs no more than its links.
    """
    edges = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        moved = large.join(low, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = store(moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        new = _state(after)
        edges, done, state = after, new == state, new
        if done:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of links and a sum of their hashes."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 40)), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]
