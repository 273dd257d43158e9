"""Connected components of an edge table, by alternating large and small stars.

Each round is two joins of the edges with each node's smallest neighbour; the
neighbours of a node are never gathered, so a node with very many links is only
a skewed join key, which Spark splits. Rounds grow with the logarithm of the
longest chain. Every round's edges are written to the shared folder and those of
the round before deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolith.llm.common import release, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over the written rows (u, v) with u > v, which are deleted after it."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written out, so that the join shuffles both sides and Spark can split a node with very many links.
        least = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        linked = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = staged(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = staged(linked.where(F.col("u") > F.col("v")).distinct(), "edges")
    release(least, edges)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long), any order -> (node, root): each linked node and its component's smallest."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges = staged(edges, "edges")
    state = None
    while True:
        edges = _star(_star(edges, True), False)
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    # A star forest now: each edge leads from a node to its root.
    out = staged(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    release(edges)
    return out
