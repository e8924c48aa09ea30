"""Connected components of an edge table by alternating large-star and small-star rounds.

A star is an aggregation with map-side minimum and a join, so a hub with any number of neighbours is
never gathered in one place. Rounds grow with the square of the logarithm of the longest path. A round is one job, whose
edges are written to shared storage; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quern.llm.common import delete, fresh_path, stash_at


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over undirected edges kept once as (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # every larger neighbour of u is linked to the least of u and its neighbours
        told = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        told = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return told.distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """Edges on shared storage, their path, and their count and checksum, all by one job."""
    seen, path = Observation(), fresh_path(edges.sparkSession, "edges")
    marked = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("sum"))
    return stash_at(marked, path), path, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node reachable.

    Self-edges and nulls are dropped, repeated edges count once; no edges give no rows.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v and v is not null").distinct()
    now, path, state = _written(start)
    while state[0]:
        then, then_path, last = _written(_star(_star(now, large=True), large=False))
        delete(edges.sparkSession, path)
        now, path, state, last = then, then_path, last, state
        if state == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()
