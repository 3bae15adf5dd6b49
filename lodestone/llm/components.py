"""Connected components by contraction: no vertex's neighbours are ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b: long) every vertex with its component's smallest vertex: v, c.

    In each round a vertex takes the smallest of itself and its neighbours as parent, then its parent's parent; edges are
    then drawn between parents. Edges within a tree vanish, so the rounds end when no edge is left (a logarithm of
    the longest path). What is stored are parents and remaining edges.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    found = None
    while True:
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p"))
        above = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        parent = stored(parent.join(above, "p").select("v", F.col("pp").alias("p")), "parents")
        first, second = parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), parent.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = edges.join(first, "a").join(second, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = stored(edges.distinct(), "edges")
        if found is None:
            found = parent.select("v", F.col("p").alias("c"))
        else:
            found = found.join(parent.select(F.col("v").alias("c"), "p"), "c", "left").select("v", F.coalesce("p", "c").alias("c"))
        if edges.isEmpty():
            return stored(found, "components")
