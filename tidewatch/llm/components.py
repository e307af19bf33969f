"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b); nodes without an edge are not listed.

    Every round hooks each root to the smallest root seen over an edge between different trees and then follows
    root to root until nothing moves, so trees at least halve in number per round; edges inside one tree are dropped.  All
    state is kept in tables, one stored table per round; the driver only sees whether edges are left.
    """
    left = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = cut_lineage(left)
    nodes = left.select("a").union(left.select("b")).distinct()
    roots = nodes.select(F.col("a").alias("node"), F.col("a").alias("root"))
    while not left.isEmpty():
        # each tree hooks to its smallest neighbour; parents are smaller than children, so there is no cycle
        hooks = cut_lineage(left.groupBy("a").agg(F.min("b").alias("parent")))
        while True:
            up = hooks.select(F.col("a").alias("parent"), F.col("parent").alias("grand"))
            stepped = hooks.join(up, "parent", "left")
            if stepped.filter("grand IS NOT NULL").isEmpty():
                break
            hooks = cut_lineage(stepped.select("a", F.coalesce("grand", "parent").alias("parent")))
        # carry the hooks over to the nodes found so far, and the edges over to the new roots
        new = hooks.select(F.col("a").alias("old"), F.col("parent").alias("new"))
        roots = roots.join(new, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
        roots = cut_lineage(roots)
        moved = left
        for end in ("a", "b"):
            moved = moved.join(new, F.col(end) == F.col("old"), "left").withColumn(end, F.coalesce("new", end)).drop("old", "new")
        left = cut_lineage(moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return roots
