"""Connected components of a distributed edge list, by the large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


class Forest:
    """Union-find over the ids of one partition; the root of a tree is its smallest id."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> tuple[list[int], list[int]]:
        nodes = list(self.up)
        return nodes, [self.root(x) for x in nodes]


def contract(edges: DataFrame) -> DataFrame:
    """The same components in each partition, as stars: no more edges than a partition has nodes."""

    def each(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
        nodes, roots = forest.stars()
        for i in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)], pa.int64()), pa.array(roots[i : i + (1 << 16)], pa.int64())], ["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(each, "a long, b long").filter("a <> b")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b); ids are not null.

    Every step keeps a > b. The least neighbours are written before they are joined with the edges, so the join has
    plain exchanges on both sides and a node with very many edges can be split. Steps go on until all is stars.
    """
    now = materialize(contract(edges), "edges")
    while True:
        roles = now.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(now.select(F.col("b").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root")))
        if roles.groupBy("n").agg(F.sum("child").alias("c"), F.max("root").alias("r")).filter("c > 1 OR (c = 1 AND r = 1)").isEmpty():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(contract(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def block_stars(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the two-sided graph of one block, for nodes that have links."""
    a, b = np.nonzero(linked)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names_a, names_b = left.copy(), right.copy()
    while True:
        old = names_a.sum() + names_b.sum()
        np.minimum.at(names_b, b, names_a[a])
        np.minimum.at(names_a, a, names_b[b])
        if names_a.sum() + names_b.sum() == old:
            break
    ua, ub = np.unique(a), np.unique(b)
    nodes, roots = np.r_[left[ua], right[ub]], np.r_[names_a[ua], names_b[ub]]
    keep = nodes != roots
    return nodes[keep], roots[keep]
