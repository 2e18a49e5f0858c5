"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach, group_facts, salt_of, staged


def _least_neighbour(sides: DataFrame) -> DataFrame:
    """(u, v, m): each row (u, v) with the least of u and its neighbours; hot u are salted."""
    salted = sides.withColumn("__salt", salt_of("v"))
    facts = group_facts(salted, "u", "__salt", [F.least(F.min("v"), F.first("u")).alias("m")])
    return attach(salted, facts, "u", "__salt").drop("__salt")


def _are_stars(edges: DataFrame) -> bool:
    """Has each node of (u, v), u above v, one neighbour below it, or neighbours above it only? Then v is the least node of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below + above > 1").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of ``links``; label is the least node it reaches.

    Large-star and small-star steps in turn: neighbours move to the least of
    them until every component is a star; links that are stars need none. The
    number of steps grows with the logarithm of a component's size. Each step is
    written to the shared folder, and removed once the next is.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = Scratch()
    edges = now.keep(edges, "links")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = now.keep(large, "large")
        small = _least_neighbour(large)  # all v are below u here
        small = small.select("u", "v", "m")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = Scratch()
        edges = after.keep(moved.filter("u <> v").distinct(), "small")
        now.clear()
        now = after
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    found = staged(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots), "components")
    now.clear()
    return found
