"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _least(edges: DataFrame) -> DataFrame:
    """(a, m) with the smallest of each node's smaller neighbours."""
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether each node with a smaller neighbour has just one, which itself has none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below + above > 1 and below > 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a long, b long); root is the smallest node of the component.

    Alternates large-star and small-star contraction, each of which keeps the components and never adds edges, until
    all edges lead to a root. Edges are kept from the larger end to the smaller, so a large star moves an edge's
    smaller end b to the smallest neighbour of b, and a small star ties all smaller neighbours of a node to the least.
    Hub nodes cost a partial minimum and a join that adaptive execution can split. Each alternation is written down,
    and the one before it deleted. No edges give no rows; null ends are not edges; repeated edges count once.
    """
    edges = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(edges):
        large = edges.join(_least(edges).withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        least = _least(large)
        others = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, edges = edges, stage(others.unionByName(least.withColumnRenamed("m", "b")).distinct())
        unstage(last)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
