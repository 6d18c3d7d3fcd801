"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import shared_dir


def _with_least(edges: DataFrame) -> DataFrame:
    """Each directed edge (u, v) and m, the least of u and all its v; partial minima come before the shuffle.

    The join's key is wrapped on the right so that both sides are shuffled for the join itself: then
    Spark can split a hub's edges over many tasks.
    """
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).select(F.struct("u").alias("k"), "m")
    return edges.withColumn("k", F.struct("u")).join(least, "k").drop("k")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, component) for every vertex that has a link to a smaller one; component is the least vertex reachable.

    edges: (u, v), bigint, in any direction, repeats and loops allowed. Vertices that are the least of
    their component are not listed. Alternates large-star and small-star steps, which need O(log n)
    rounds; each round's edges are checkpointed to the shared folder, so that lost executors don't
    cost the rounds before.
    """
    shared_dir(edges.sparkSession)
    state = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _with_least(large)
        small = least.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        state = small.filter("u != v").distinct().checkpoint()
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            return state.select(F.col("u").alias("v"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
