"""Connected components of an edge table, by rounds of joins and combined aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.shared import cut


def _rank(name: str):
    """Order of nodes by hash, so that no numbering of the nodes makes many rounds."""
    return F.struct(F.xxhash64(name), F.col(name))


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) of every node of the edges (``a``, ``b``); ``root`` is one node of its component.

    Each round maps a node to the first, by hash, of itself and its neighbours and replaces both ends of
    all edges, so a round removes a constant share of the nodes that still have edges. The table of edges
    is cut after each round. A node with a third of all edges is no hot key: its neighbours meet in a
    combined minimum, and the joins bring one row a node. No edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(pairs.distinct())
    found = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(_rank("b")).alias("best"))
        step = cut(best.select(F.col("a").alias("node"), F.when(
            F.col("best") < _rank("a"), F.col("best.b")).otherwise(F.col("a")).alias("to")))
        if found is None:
            found = step.withColumnRenamed("to", "root")
        else:
            found = cut(found.join(step.withColumnRenamed("node", "root"), "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")))
        moved = pairs
        for end in ("a", "b"):
            moved = moved.join(step.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("to", end)
        pairs = cut(moved.where("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if pairs.isEmpty():
            return found
