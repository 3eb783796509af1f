"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a shuffle on the node with partial aggregation; no neighbour list is collected, so a node
with very many links is only rows that a skewed join may split. Edges are rewritten into the shared
folder after each round, which bounds the plan and survives lost executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """node, root: for each node of an edge the smallest node that it reaches.

    Nodes are longs. Self-links, repeated and reversed edges are allowed and change nothing, save that a
    node that occurs in no other edge is its own root; edges with a null end are ignored; an empty table
    gives no rows.
    """
    ends = common.materialize(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL"), "links")
    size = ends.count()
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    star = common.materialize(common.gathered(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), size), "links")
    for _ in range(max_rounds):
        if _settled(star):
            break
        star = common.materialize(common.gathered(_small_star(_large_star(star)), size), "links", instead=star)
    else:
        raise RuntimeError(f"components: no fixed point in {max_rounds} rounds")
    return nodes.join(star.withColumnsRenamed({"u": "node", "v": "root"}), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _settled(star: DataFrame) -> bool:
    """Whether every link leads to a root: no node has two links down, and none that has one is linked to. Then each
    component is a star around its smallest node, and further steps change nothing."""
    ends = star.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.down").alias("down"), F.max("e.up").alias("up"))
    return not nodes.where("down > 1 OR (down = 1 AND up = 1)").limit(1).count()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's smallest neighbour. Edges have u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are linked to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of 0..n-1 reaches over the links a[i]-b[i], within one task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
