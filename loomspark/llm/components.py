"""Connected components of an edge table, by alternating stars.

Large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014) shorten all paths until every node points at the
smallest node of its component.  A node's neighbours are never gathered: the
least one is an aggregate, combined before its shuffle, and a join brings it
back, which adaptive execution splits where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, larger node first, without loops."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return _ordered(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) for every node of ``edges(a long, b long)``; root is the component's smallest node."""
    now = scratch.save(_ordered(edges))
    while True:
        step = scratch.save(_small_star(_large_star(now)))
        # Both tables hold distinct edges, so equal sizes and no new edge mean equal tables.
        same = step.count() == now.count() and step.join(now, ["a", "b"], "left_anti").isEmpty()
        scratch.drop(now)
        now = step
        if same:
            break
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("id"), "root").distinct())
