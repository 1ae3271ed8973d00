"""Connected components by alternating large-star and small-star steps.

Follows Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
Every step is an aggregation and an equi-join with one row per node on one
side, which adaptive execution splits where a node gathers many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from herdlens.operators.skew import lookup_join
from herdlens.session import materialize


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """Write the edges; count and fingerprint come out of the same job."""
    seen = Observation()
    observed = edges.observe(
        seen,
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark"),
    )
    table = materialize(observed, name)
    return table, (seen.get["n"], seen.get["mark"])


def _relinked(edges: DataFrame, nearest: DataFrame) -> DataFrame:
    """Point the far end of each edge to the least node near its ``u``."""
    return lookup_join(edges, nearest, ["u"], "inner", broadcasts=False)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    nearest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where("v > u")
    return _relinked(larger, nearest).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    nearest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _relinked(edges, nearest).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(nearest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node with an edge; a component is its least node.

    ``edges`` has columns ``u`` and ``v``, in any direction.
    """
    start = edges.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    current, mark = _written(start, "edges")
    while mark[0]:
        # The first step may shrink the edges, never more than double them.
        following, after = _written(_small_star(_large_star(current)), "edges")
        current, mark, before = following, after, mark
        if mark == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
