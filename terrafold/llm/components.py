"""Connected components of a graph given as a table of edges.

Alternates the large-star and small-star steps of Kiveris et al. (2014) until
the edges no longer change; every remaining edge then leads from a node to the
smallest node of its component. A step takes minima with partial aggregation and
joins them back, so a node with very many neighbours is a skewed join at most.
Each round is stored in place of the one before, so neither the lineage, the driver nor
the disk grows with the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from terrafold.session import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to its smallest one (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of every node, and the node, to the smallest one."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stored(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The stored edges, and their number and a sum of their hashes, taken while they are written."""
    seen = Observation()
    sums = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")
    return materialize(edges.observe(seen, *sums), "edges"), seen.get


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node it can reach, ``component``, for every node with an edge.

    ``edges`` has the columns ``u`` and ``v``; loops, repeated edges and either
    direction are allowed, nulls are not.
    """
    now, state = _stored(edges.where("u <> v").select("u", "v").distinct())
    before = None
    while state != before:
        old, before = now, state
        now, state = _stored(_small_star(_large_star(now)))
        release(old)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
