"""Connected components of an edge table, by alternating large and small stars.

Links stay distributed; every round is written to the shared folder, so its lineage is short. A vertex with very many
neighbours costs one row per neighbour: its minimum is a partial aggregate and comes back by a broadcast of the few such vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from transmuta.functions.joins import lookup_join
from transmuta.functions.materialize import Written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return lookup_join(both.filter("v > u"), least, ["u"], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
        .union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge, from edges (a, b) of two different nodes; component: its smallest node."""
    state = Written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = state.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        after = Written(_small_star(_large_star(state.df)), "edges")
        state.drop()
        state = after
    found = state.df
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .union(found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
