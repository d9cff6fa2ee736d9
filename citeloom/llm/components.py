"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import Scratch, scratch_of


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v). Large: each neighbour above u is tied to the least of u and its neighbours; small: the same below u."""
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    tied = pairs.join(least, "u")
    if large:
        out = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node that an edge (u, v) has; the component is its least node.

    Every round is stored, so a lost executor repeats one round at most. Ends when a round changes nothing, and
    fails if none of most_rounds does; the rounds grow with the logarithm of the longest chain. Self loops and
    repeated edges are harmless, an edge with a null is no edge, and no edges give no rows.
    """
    scratch = scratch_of(edges, scratch, "components")
    state = scratch.stored(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        state = scratch.stored(_star(_star(state, True), False), "stars")
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == now:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).distinct()
