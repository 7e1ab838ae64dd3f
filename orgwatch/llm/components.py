"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _shortcut(hooks: DataFrame) -> DataFrame:
    """(node, root) from (node, up), where ``up`` is always less than ``node``: each round doubles the way that a
    pointer has gone, so a chain of n nodes takes log2(n) rounds of one join over the nodes."""
    while True:
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("_next"))
        new = cut_lineage(hooks.join(above, "up", "left").select("node", F.coalesce("_next", "up").alias("up"), F.col("_next").isNotNull().alias("_moved")))
        hooks = new.select("node", "up")
        if new.where("_moved").isEmpty():
            return hooks.withColumnRenamed("up", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); ``root`` is the least node of its component.

    Every node first hooks to the least of its lesser neighbours (a map-side minimum, no join); pointers are followed to
    the roots of these trees, and then both ends of every edge are replaced by their roots. What lies inside one tree
    drops out, so the edges shrink each round, and the rest is contracted again until none is left. Every round is
    written to the shared folder; nothing but whether rows are left reaches the driver.
    """
    left = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    found = left.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    while not left.isEmpty():
        near = _shortcut(left.groupBy("a").agg(F.min("b").alias("up")).withColumnRenamed("a", "node"))
        at = lambda c: near.select(F.col("node").alias(c), F.col("root").alias("_root"))
        # A node that already has a root follows it; the nodes of this round had none.
        found = cut_lineage(found.join(at("root"), "root", "left").select("node", F.coalesce("_root", "root").alias("root")).unionByName(near))
        once = left.join(at("a"), "a").select(F.col("_root").alias("a"), "b").where("a <> b").distinct()
        left = once.join(at("b"), "b", "left").select("a", F.coalesce("_root", "b").alias("b")).where("a <> b")
        left = cut_lineage(left.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
