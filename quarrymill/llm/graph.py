"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, join_groups, write_table


def _star(edges: DataFrame, large: bool, n_edges: int) -> DataFrame:
    """One step over edges (a, b): link neighbours to the least node around, larger ones (large) or smaller ones."""
    if large:
        ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        ways = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = write_table(ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("degree")), "least")
    linked = join_groups(ways, least, "u", "degree", n_edges)  # a hub meets its edges by broadcast
    if large:
        out = linked.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = linked.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): the least node that it reaches.

    Ends when a round changes no edge; the edges then are stars around the least nodes.
    """
    edges = write_table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    digest = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = digest(edges)
    while before[0]:
        stars = write_table(_star(edges, True, 2 * before[0]), "edges")
        stepped = write_table(_star(stars, False, before[0]), "edges")
        drop_table(stars)
        drop_table(edges)
        edges, now = stepped, digest(stepped)
        if now == before:
            break
        before = now
    out = edges.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("node"), "component")
    return out.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
