"""Connected components over a table of edges, by alternating large and small stars.

Each round points every node's larger neighbours to its least neighbour, then its smaller ones; node minima are combined
before the shuffle, so a node that a third of all edges meet is no single task's group. Rounds are cut by tables in the
shared folder, and their number grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = seen.join(least, "u")
    out = met.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v): the least node that can be reached. u and v have the same
    orderable type and are not null; repeated edges and loops don't matter; no edges, no rows."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = stage(edges.where("u <> v").distinct(), "edges")
    known = mark(edges)
    while known[0]:
        edges = stage(_star(_star(edges, True), False), "edges")
        now = mark(edges)
        if now == known:
            break
        known = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
