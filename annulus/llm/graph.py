"""Connected components of an edge table, in rounds of star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(near: DataFrame) -> bool:
    """Whether every node of ``near`` (u, its least neighbour m, the number n of them) has larger neighbours only, or one, a smaller one."""
    # a written table's partitions are read some at a time: what they are combined into is one row a task
    few = near.coalesce(max(16, near.rdd.getNumPartitions() // 16))
    return not few.agg(F.max((F.col("m") < F.col("u")) & (F.col("n") > 1)).alias("more")).first().more


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (u, v); component is its smallest node.

    Large-star and small-star steps alternate until all is stars around least nodes; each step takes a minimum per node
    and joins it back, so that a node with very many edges is combined before the shuffle and its join
    can be split. The number of rounds grows with the logarithm of the longest chain; edges that are stars
    already take none. No edge gives no rows.
    """
    now = cut(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        near = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        if _stars(near):
            break
        least = near.select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        # larger neighbours of each node go to the least of its neighbourhood
        large = now.join(least, F.col("v") == F.col("c")).select("u", F.col("m").alias("v"))
        # smaller neighbours and the node itself go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return near.select(F.col("u").alias("node"), F.least("u", "m").alias("component"))


def merged(linked: DataFrame, links: DataFrame) -> DataFrame:
    """``linked`` (node, component) after more ``links`` (u, v) between components: only these are connected, not all edges again.

    A node that isn't in ``linked`` is a component of its own.
    """
    above = components(links)
    moved = linked.join(above.toDF("component", "above"), "component", "left").select("node", F.coalesce("above", "component").alias("component"))
    return cut(moved.unionByName(above).distinct())
