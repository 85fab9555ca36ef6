"""Connected components of an edge list, labelled by their least node."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that has an edge to another node; ``root`` is the least node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Both are a minimum
    per node (combined before the shuffle) and an equi-join, so a node of very high degree is no
    problem, and the number of rounds grows with the logarithm of the longest path. Every round
    ends in a written table. Edges with a null end, loops and repeated edges count for nothing.
    """
    scratch = Scratch(spark, "components")
    now = scratch.put(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`").distinct(), "round0"
    )
    before = None
    for i in range(1, max_rounds + 1):
        # Large star: a node's greater neighbours move to its least neighbour or itself.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = scratch.put(small.distinct(), f"round{i}")
        state = tuple(after.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        now = after
        if state == before:
            break
        before = state
        if i > 1:
            scratch.drop(f"round{i - 2}")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a[i], b[i] in ascending order, and of each the least node that edges lead to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[u] != root[v]).any():
        p, q = root[u], root[v]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]
