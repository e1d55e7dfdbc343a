"""Connected components of an edge table by alternating large and small stars; no group is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Each node's (larger or smaller) neighbours are tied to its least neighbour.

    The least neighbours are a table of their own, so that the join can split the edges of a hot node.
    """
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    low = scratch.keep(low, "low")
    tied = (both.where("v > u") if large else both.where("v < u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        tied = tied.unionAll(low.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of every node that has an edge (u, v): comp is the least node of its component."""
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        now = scratch.keep(_stars(scratch.keep(_stars(now, True, scratch), "large"), False, scratch), "edges")
        # Done when every edge leads to a root: no node has two edges, and none that an edge leads to has one.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("end")).unionAll(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("end").alias("end")).where("out > 1 or out + end > 1").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
