"""Connected components of a graph of many nodes, by hooking and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import dropped, written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root): the least node reachable over edges (x, y). Rounds until nothing changes, each written.

    A round hooks a node's root to the least root next to it, then jumps pointers; the number of rounds grows
    with the logarithm of the longest path. Nodes without edges are their own root."""
    both = edges.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(edges.select(F.col("y").alias("a"), F.col("x").alias("b"))).distinct()
    both = written(both, "edges")
    if both.isEmpty():
        dropped(both)
        return written(nodes.select("fp", F.col("fp").alias("root")), "components")
    root = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "fp")
    root = written(root, "roots")
    while True:
        of_b = root.select(F.col("fp").alias("b"), F.col("root").alias("root_b")).hint("merge")
        of_a = root.select(F.col("fp").alias("a"), F.col("root").alias("root_a")).hint("merge")
        met = both.join(of_b, "b").join(of_a, "a").where("root_b < root_a")
        hooks = met.groupBy(F.col("root_a").alias("old")).agg(F.min("root_b").alias("new"))
        hooks = written(hooks, "hooks")
        if hooks.isEmpty():
            break
        moved = root.join(hooks.withColumnRenamed("old", "root"), "root", "left").select("fp", F.coalesce("new", "root").alias("root"))
        for _ in range(2):
            up = moved.select(F.col("fp").alias("root"), F.col("root").alias("up"))
            moved = moved.join(up, "root", "left").select("fp", F.coalesce("up", "root").alias("root"))
        moved = written(moved, "roots")
        dropped(root, hooks)
        root = moved
    out = written(nodes.select("fp").join(root.hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "components")
    dropped(both, root, hooks)
    return out


def merged(root: DataFrame, edges: DataFrame) -> DataFrame:
    """The groups of ``root`` (fp, root; written, and dropped here) as further edges (x, y) join them.

    Edges count once, as one edge between two groups; those within a group end here."""
    of = lambda c: root.select(F.col("fp").alias(c), F.col("root").alias(f"root_{c}")).hint("merge")
    apart = edges.join(of("x"), "x").join(of("y"), "y").where("root_x <> root_y")
    apart = written(apart.select(F.greatest("root_x", "root_y").alias("x"), F.least("root_x", "root_y").alias("y")).distinct(), "apart")
    if apart.isEmpty():
        dropped(apart)
        return root
    groups = apart.select(F.col("x").alias("fp")).unionByName(apart.select(F.col("y").alias("fp"))).distinct()
    joined = components(groups, apart)
    out = written(root.join(joined.select(F.col("fp").alias("root"), F.col("root").alias("up")), "root", "left").select("fp", F.coalesce("up", "root").alias("root")), "components")
    dropped(root, apart, joined)
    return out
