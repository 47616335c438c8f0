"""Connected components of link tables, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetdelta.session import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star round over edges ``a > b``: neighbours of a node move to its smallest one.

    The large star moves larger neighbours, the small star the others and the node itself.
    """
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not small:
        around = around.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    lowest = around.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    moved = around.join(lowest, "u")
    if small:
        out = moved.select(F.col("v").alias("a"), F.col("low").alias("b")).unionByName(
            lowest.select(F.col("u").alias("a"), F.col("low").alias("b"))
        )
    else:
        out = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("low").alias("b"))
    return out.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; root is the smallest node reachable.

    ``links`` holds two long columns ``a`` and ``b`` in any order, repeats and loops
    allowed; null ends are left out. Each round rewires neighbours to the smallest
    neighbour until every node hangs on its root, which takes a logarithmic number of
    rounds. Rounds are written tables, so a lost executor costs one round.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges = cut(edges)
    seen = None
    while True:
        edges = cut(_star(_star(edges, small=False), small=True))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
