"""Distributed connected components by alternating large-star and small-star steps.

Every step is a minimum over neighbours (added up before the shuffle) and a join back on the node, so a hub
is one aggregate row and its edges can be split by the adaptive skew join. Edges are cut off from their
lineage in the shared folder after every round; no edges or components reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm import scratch


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return scratch.checkpoint(edges.groupBy("u").agg(F.min("v").alias("m")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)``; the root is the component's least node.

    Self-loops, repeated edges and nulls are ignored. No edges: an empty table.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.checkpoint(now)
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        least = _least_neighbour(both)
        large = scratch.checkpoint(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # u's smaller neighbours, of which the last step has left few
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = scratch.checkpoint(small.filter("u <> v").distinct())
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))
