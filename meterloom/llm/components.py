"""Connected components by alternating large and small stars (Kiveris et al., 2014).

Everything stays in DataFrames: a round is two aggregations and two joins on
the node, so a hub with a third of all edges is pre-aggregated before the
shuffle, and adaptive execution can split its partition of a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, own_exchange


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node u to the least node around u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least.select(own_exchange("u"), "m"), "u")
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    around = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return around.unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph.

    ``edges`` has two columns of longs.  Returns ``node, root``
    with a row for every node that has an edge to another node, the least ones
    included; ``root`` is the least node that can be reached.  Loops and repeated edges are ignored, null
    ends are dropped, and no edges give no rows.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges, before = durable(edges), None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, larger_only=True).distinct()
        edges = durable(_star(large, larger_only=False).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
