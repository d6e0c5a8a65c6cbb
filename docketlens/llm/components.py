"""Connected components by alternating large-star and small-star steps.

Nothing is collected: each round is a combining minimum per node and an
equi-join, written to the shared folder.  Edges keep the components they had,
so stopping depends only on the edges no longer changing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = (both.filter("v > u").join(least, "u")
             .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
    small_min = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(small_min, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(small_min.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Links (a, b), any direction, to (node, component): the smallest node reachable.

    Nodes without a link to another node get no row.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = staged(_round(edges), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
