"""One whole trace: level, anchor, inherited anchor, a walk under a budget, and the hierarchy around what it found."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.governance import resolved_levels
from tracewell.operators.hierarchy import anchors_at_level
from tracewell.operators.traversal import hop_pairs
from tracewell.sources.shared import cut, small, stored

MAX_NODES, MAX_SECONDS, CANDIDATES = 2000, 8.0, 5
SUMMARY = "focus_urn string, focus_level int, level int, anchor_urn string, inherited boolean, inherited_from string, truncated boolean, reason string, hops int"


@dataclass(frozen=True)
class Trace:
    """nodes: urn, side (start, upstream, downstream, ancestor), depth (null for ancestors). edges: source_urn,
    target_urn, weight, edge_types, hop (the first that met it). containment: parent_urn, child_urn among all
    nodes. summary: one row."""

    nodes: DataFrame
    edges: DataFrame
    containment: DataFrame
    summary: DataFrame
    hops: int


def has_pair(pairs: DataFrame, urns: DataFrame) -> DataFrame:
    """Those of a few urns that are an end of a pair."""
    n = urns.count()
    met = lambda side: pairs.join(small(urns.select(F.col("urn").alias(side)), n), side, "left_semi").select(F.col(side).alias("urn"))
    return met("source_urn").union(met("target_urn")).distinct()


def inheriting(pairs: DataFrame, closure: DataFrame, nodes: DataFrame, anchor: DataFrame, level: int) -> DataFrame:
    """urn, lacking: the anchor where it has a pair (lacking is null), else the nearest of its first CANDIDATES
    ancestors of the level that has one (lacking is the anchor), else the anchor. One row."""
    at = nodes.where(F.col("level") == level).select(F.col("urn").alias("ancestor_urn"))
    up = closure.join(F.broadcast(anchor.select("urn")), "urn").join(at, "ancestor_urn", "left_semi")  # anchor: one row
    near = up.orderBy("dist", "ancestor_urn").limit(CANDIDATES).select(F.col("ancestor_urn").alias("urn"), "dist")
    asked = cut(anchor.select("urn", F.lit(0).alias("dist")).union(near))
    known = asked.join(has_pair(pairs, asked).withColumn("has", F.lit(True)), "urn", "left")
    row = known.agg(F.min_by("urn", "dist").alias("own"), F.min_by(F.when(F.col("has"), F.col("urn")), F.when(F.col("has"), F.struct("dist", "urn"))).alias("best"))
    start = F.coalesce("best", "own")
    return row.select(start.alias("urn"), F.when(start != F.col("own"), F.col("own")).alias("lacking"))


def walk(pairs: DataFrame, start: DataFrame, up_depth: int, down_depth: int, max_nodes: int, seconds: float | None = None) -> tuple[DataFrame, DataFrame, str | None, int]:
    """(urn, side, depth), (source_urn, target_urn, weight, edge_types, hop), why it stopped early, hops that were read.

    Up and down have frontiers of their own and share what was visited and a budget of max_nodes, the start
    included. A hop reads the pairs once, for both sides; a node that both meet is upstream. The nearest nodes come
    first, then the smaller urn: a hop that would pass the budget gives what fits, and the walk ends. So
    it makes no more than max_nodes nodes, and reads nothing behind them: a budget that is spent with hops left is
    a reason even where nothing would have come. Cycles end, as seen nodes drop out."""
    began, reason, hop = time.monotonic(), None, 0
    seen = cut(start.select("urn", F.lit("start").alias("side"), F.lit(0).alias("depth")))
    front, total, met = seen.select("urn", F.array(*[F.lit(s) for s, d in (("upstream", up_depth), ("downstream", down_depth)) if d > 0]).cast("array<string>").alias("sides")), seen.count(), []
    n = total if max(up_depth, down_depth) else 0
    while n and hop < max(up_depth, down_depth):
        if total >= max_nodes:
            reason = "max_nodes"
        elif seconds is not None and time.monotonic() - began > seconds:
            reason = "timeout"
        if reason:
            break
        hop += 1
        at = small(front.select(F.col("urn").alias("at"), F.explode("sides").alias("side")), 2 * n)
        up = pairs.join(at.where("side = 'upstream'"), pairs["target_urn"] == F.col("at")).select("source_urn", "target_urn", "weight", "edge_types", "side", F.col("source_urn").alias("urn"))
        down = pairs.join(at.where("side = 'downstream'"), pairs["source_urn"] == F.col("at")).select("source_urn", "target_urn", "weight", "edge_types", "side", F.col("target_urn").alias("urn"))
        now = cut(up.union(down))
        met.append(now.select("source_urn", "target_urn", "weight", "edge_types", F.lit(hop).alias("hop")))
        new = now.groupBy("urn").agg(F.max("side").alias("side")).join(small(seen.select("urn"), total), "urn", "left_anti")
        room = max_nodes - total
        new = cut(new.orderBy("urn").limit(room + 1))
        n = new.count()
        if n > room:
            reason, new, n = "max_nodes", new.orderBy("urn").limit(room), room
        seen, total = seen.union(new.select("urn", "side", F.lit(hop).alias("depth"))), total + n
        more = [F.when(F.lit(hop < d), F.lit(s)) for s, d in (("upstream", up_depth), ("downstream", down_depth))]
        front = new.select("urn", F.array_compact(F.array(*[F.when(F.col("side") == s, c) for s, c in zip(("upstream", "downstream"), more, strict=True)])).alias("sides")).where(F.size("sides") > 0)
        n = front.count() if n else 0
        if reason:
            break
    edges = None
    for e in met:
        edges = e if edges is None else edges.union(e)
    if edges is None:
        edges = pairs.limit(0).select("source_urn", "target_urn", "weight", "edge_types", F.lit(0).alias("hop"))
    inside = small(seen.select("urn"), total)
    edges = edges.join(inside.withColumnRenamed("urn", "source_urn"), "source_urn", "left_semi").join(inside.withColumnRenamed("urn", "target_urn"), "target_urn", "left_semi")
    once = edges.groupBy("source_urn", "target_urn").agg(F.first("weight").alias("weight"), F.first("edge_types").alias("edge_types"), F.min("hop").alias("hop"))
    return seen, once, reason, hop


def trace(pairs: DataFrame, closure: DataFrame, nodes: DataFrame, containment: DataFrame, types: DataFrame, urn: DataFrame, level: str = "auto", up_depth: int = 3, down_depth: int = 3, edge_types: list[str] | None = None, inherited: bool = True, max_nodes: int = MAX_NODES, seconds: float | None = MAX_SECONDS) -> Trace:
    """The trace of one node (urn: one row). pairs: rolled-up pairs with source_level and target_level.

    level: `auto` (the node's own), a number or a type id of types (type_id, level); an unknown one is auto, and
    level 0 stands for a node that is missing. The anchor is the nearest of the node and its ancestors of the level,
    else the node. If it has no pair of the level and of edge_types and `inherited` holds, the walk starts
    from the nearest ancestor of the level that has one, and inherited_from names the anchor that lacked it. Ancestors
    of all nodes found, and the containment among them, are always added, beyond the budget.

    summary: focus_urn, focus_level (null where unknown), level, anchor_urn, inherited, inherited_from, truncated, reason
    (max_nodes or timeout), hops."""
    asked = cut(resolved_levels(urn.select("urn", F.lit(level).alias("spec")), nodes, types).join(nodes.select("urn", F.col("level").alias("focus_level")), "urn", "left"))
    at = asked.first()["level"]  # one row; files of pairs are chosen by it
    own = hop_pairs(pairs.where((F.col("source_level") == at) & (F.col("target_level") == at)), edge_types)
    own = stored(own.select("source_urn", "target_urn", "weight", "edge_types"), "level")  # every hop reads it
    anchor = cut(anchors_at_level(closure.join(F.broadcast(asked.select("urn")), "urn", "left_semi"), nodes, at, asked).select(F.col("anchor").alias("urn")))
    start = cut(inheriting(own, closure, nodes, anchor, at) if inherited else anchor.select("urn", F.lit(None).cast("string").alias("lacking")))
    found, edges, reason, hops = walk(own, start, up_depth, down_depth, max_nodes, seconds)
    found = cut(found)
    above = closure.join(small(found.select("urn"), max_nodes), "urn", "left_semi").select(F.col("ancestor_urn").alias("urn")).distinct()
    every = cut(found.union(above.join(found, "urn", "left_anti").select("urn", F.lit("ancestor"), F.lit(None).cast("int"))))
    ends = small(every.select("urn"), every.count())
    inside = containment.join(ends.withColumnRenamed("urn", "parent_urn"), "parent_urn", "left_semi").join(ends.withColumnRenamed("urn", "child_urn"), "child_urn", "left_semi").select("parent_urn", "child_urn")
    a, s = asked.first(), start.first()  # a row each
    row = (a["urn"], a["focus_level"], at, s["urn"], s["lacking"] is not None, s["lacking"], reason is not None, reason, hops)
    summary = nodes.sparkSession.createDataFrame([row], SUMMARY)
    return Trace(every, edges.select("source_urn", "target_urn", "weight", "edge_types", "hop"), inside, summary, hops)
