"""Connected components of an edge table by alternating star contraction.

Nodes are 64-bit integers. Each round relinks, per node, the larger neighbours
(large star) and then the smaller ones (small star) to the least of them. A hub
of any degree is only a minimum and a join, split by adaptive execution.
Rounds are written tables, so that a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window  # noqa: F401
from pyspark.sql import functions as F

from .common import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b) relinked to the least of a node and its neighbours."""
    links = _both_ways(edges) if large else edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = links.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (least node of the component) of each node that has a link; edges in columns ``a, b``."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = stage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")), "edges")
    before = None
    while True:
        now = stage(_star(_star(now, True), False), "edges")
        # Done when every node has one link: a forest of stars.
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
