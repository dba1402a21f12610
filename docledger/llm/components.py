"""Connected components of a graph given as rows of edges, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.shared import written


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star operation on (u, v) edges.

    The small star points a node's smaller neighbours, and the node itself, to the smallest of them; the large star
    points its larger neighbours to the smallest of all. The smallest neighbour is a grouped minimum that combines before
    the shuffle, and comes back by a join that can be split on a hot node, so no node's neighbours meet in one task.
    """
    if small:
        out = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        out = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = out.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    joined = out.join(least, "u")
    if small:
        kept = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
    else:
        kept = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return kept.where("u <> v").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (u, v): ``root`` is the smallest node it reaches.

    Each round is written to the shared folder. The number of rounds grows with the logarithm of the longest chain. Loops
    and repeated edges are allowed; a table without edges gives no rows.
    """
    edges = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-edges")
    state = None
    while True:
        edges = written(_stars(_stars(edges, small=False), small=True), f"{name}-stars")
        # Ends when a round changes nothing: equal counts, sums of nodes and of hashed edges.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
