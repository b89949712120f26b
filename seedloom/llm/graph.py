"""Connected components of an edge table, for the operators that link documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.llm.common import scratch

#: Nodes with more edges than this, and than 1 / HUBS of all, are hubs: there are at most HUBS of them, so that they may be broadcast.
HUB_EDGES, HUBS = 256, 10_000


def _moved(rows: DataFrame, least: DataFrame, hub_edges: int) -> DataFrame:
    """``rows`` (``u, v``) with ``m``, the least node about ``u``, from ``of, m, n`` rows.

    Edges of hubs meet a broadcast table where they lie; only those of other nodes are shuffled.
    """
    hubs = F.broadcast(least.where(F.col("n") > hub_edges).select("of", "m"))
    others = least.where(F.col("n") <= hub_edges).select("of", "m")
    match = F.col("u") == F.col("of")
    return rows.join(hubs, match).drop("of").unionByName(rows.join(hubs.select("of"), match, "left_anti").join(others, match).drop("of"))


def _larger(edges: DataFrame, hub_edges: int) -> DataFrame:
    """Each node's larger neighbours move to the least node about it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("of")).agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n"))
    return _moved(both.where("v > u"), least, hub_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _smaller(edges: DataFrame, hub_edges: int) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _moved(down, least, hub_edges).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("of").alias("u"), F.col("m").alias("v"))).where("u <> v")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one edge and is no ``v``."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node with an edge, the component named by its least node.

    ``edges`` has bigint columns ``u`` and ``v`` (no nulls, loops are ignored). Large-star and
    small-star steps alternate until the edges are stars about least nodes; each round is written to the
    checkpoint folder. Hubs are summed before they are shuffled, and their edges are not
    shuffled to them.
    """
    current = scratch(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    hub_edges = max(HUB_EDGES, 2 * current.count() // HUBS)
    while not _are_stars(current):
        current = scratch(_smaller(_larger(current, hub_edges).distinct(), hub_edges).distinct())
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
