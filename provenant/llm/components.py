"""Connected components of a graph that is a table of edges, by alternating large-star and small-star steps.

Each step is a few shuffles; a handful of rounds do, since the distance to a component's smallest node halves. Nothing
is collected; each step's edges are a written table in the shared folder, so a lost executor costs one step. A node
that a component's others all point to, however many they are, is attached by its degree (`attach_by_key`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key, written


def _with_least(pairs: DataFrame, total: int) -> DataFrame:
    """pairs (u, v), of which there are `total`, with the least v of each u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("degree"))
    return attach_by_key(pairs, least, ["u"], "degree", total)


def components(edges: DataFrame) -> DataFrame:
    """(node, root), root the smallest node of node's component, for all nodes of `edges` (a, b) but the roots themselves."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    n, mark = now.count(), None
    while True:
        # large star: each node's greater neighbours are joined to the least of it and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        large = written(large.where("u <> v").distinct(), "large-stars")
        # small star: each node and its smaller neighbours are joined to the least of these
        small = _with_least(large, n)
        others = small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        now = written(small.select("u", F.col("least").alias("v")).unionByName(others).distinct(), "small-stars")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.count_distinct("u")).first()
        if tuple(new) == mark and new[0] == new[2]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        n, mark = new[0], tuple(new)
