"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billgrain.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node, above it (large) or not above it (small), on its least one."""
    if large:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
    return moved.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of an edge ``u, v``; the root is the least node of the component.

    Large and small stars by turns, until each component is one star: every round is a few
    joins on nodes with minima combined before the shuffle, and is written to the shared
    folder. Loops and repeated edges are harmless; nodes must not be null.
    """
    edges = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        edges = stored(_star(_star(edges, True), False))
        # a star for each component: no node hangs on two, and no centre hangs on another
        state = edges.agg(F.count("*"), F.count_distinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
