"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import materialise


def _lowest(edges: DataFrame, name: str) -> DataFrame:
    """u -> its lowest neighbour, as a table of its own so that a join with it can split a hub's rows."""
    return materialise(edges.groupBy("u").agg(F.min("v").alias("m")), name)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def stars(edges: DataFrame) -> DataFrame:
    """u, v: for each node but a component's lowest, that lowest node. edges: u, v, any direction.

    Each step is a table in the shared folder, so a lost executor costs one step at most. The number
    of steps grows with the logarithm of the component size. Loops and repeated edges are ignored."""
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both, "large").select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large_star")
        low = _lowest(large, "small")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small, "small_star")
        before, state = state, _state(now)
    return now
