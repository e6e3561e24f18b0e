"""Connected components of a distributed edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) to (node, component) for every node with an edge; component is the smallest node reachable.

    Each round hangs neighbours under the smallest node seen, first upwards, then downwards; the minimum of a node's
    neighbours is a partial aggregate and meets the edges in a join, so a hub's edges never gather in one task. Rounds
    grow with the logarithm of the longest chain. Every round is cut by a reliable checkpoint."""
    now = cut(_directed(edges))
    seen = _state(now)
    while seen[0]:
        now = cut(_small_star(_large_star(now)))
        state = _state(now)
        if state == seen:
            break
        seen = state
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(least, both["u"] == least["k"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _directed(edges)
    least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    moved = down.join(least, down["u"] == least["k"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _directed(moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))))
