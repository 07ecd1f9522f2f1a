"""Bounded traversals over lineage edges, as frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.hierarchy import anchor_of, descendants_at_level, with_self
from tracewell.sources.shared import cut, small


def arcs(edges: DataFrame, direction: str) -> DataFrame:
    down = edges.select(F.col("source_urn").alias("at"), F.col("target_urn").alias("to"))
    up = edges.select(F.col("target_urn").alias("at"), F.col("source_urn").alias("to"))
    return down if direction == "downstream" else up


def reach(edges: DataFrame, starts: DataFrame, direction: str, depth: int, types: list[str] | None = None) -> DataFrame:
    """urn, depth: nodes reached from the starts (column urn) in at most depth hops, by their shortest; starts excluded. Only edges
    of the types are taken, if any are given: stored edges of other types are not read.

    Each hop joins the new nodes alone, and nodes seen before drop out, so cycles end. While a counted frontier
    is small it is broadcast, so that the edges are read once a hop and not shuffled."""
    step = arcs(edges.where(F.col("edge_type").isin(types)) if types else edges, direction)
    front = seen = cut(starts.select("urn", F.lit(0).alias("depth")).distinct())
    n = total = front.count()
    for hop in range(1, max(1, min(depth, 20)) + 1):
        new = step.join(small(front.select(F.col("urn").alias("at")), n), "at").select(F.col("to").alias("urn")).distinct()
        front = cut(new.join(small(seen.select("urn"), total), "urn", "left_anti").withColumn("depth", F.lit(hop)))
        n = front.count()
        if not n:
            break
        seen, total = seen.union(front), total + n
    return seen.where("depth > 0")


def subgraph(edges: DataFrame, urns: DataFrame) -> DataFrame:
    """Edges with both ends among the urns."""
    ends = urns.select("urn").distinct()
    return edges.join(ends.withColumnRenamed("urn", "source_urn"), "source_urn", "left_semi").join(ends.withColumnRenamed("urn", "target_urn"), "target_urn", "left_semi").select(edges.columns)


def full_lineage(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """urn, upstream, downstream: what is reached either way."""
    up = reach(edges, starts, "upstream", depth).select("urn", F.lit(True).alias("u"), F.lit(False).alias("d"))
    down = reach(edges, starts, "downstream", depth).select("urn", F.lit(False).alias("u"), F.lit(True).alias("d"))
    return up.union(down).groupBy("urn").agg(F.max("u").alias("upstream"), F.max("d").alias("downstream"))


def trace_both(edges: DataFrame, containment: DataFrame, urn: DataFrame, depth: int) -> DataFrame:
    """urn, depth, side. Starts: the urn and its children. Each hop goes both ways from all nodes of the
    last hop, so the direction may turn; a node found both ways in a hop counts as upstream."""
    kids = containment.join(urn.select(F.col("urn").alias("parent_urn")), "parent_urn", "left_semi").select(F.col("child_urn").alias("urn"))
    front = seen = cut(urn.select("urn").union(kids).distinct().select("urn", F.lit(0).alias("depth"), F.lit("start").alias("side")))
    n = total = front.count()
    both = arcs(edges, "upstream").withColumn("u", F.lit(1)).union(arcs(edges, "downstream").withColumn("u", F.lit(0)))
    for hop in range(1, depth + 1):
        met = both.join(small(front.select(F.col("urn").alias("at")), n), "at").groupBy(F.col("to").alias("urn")).agg(F.max("u").alias("u"))
        new = met.join(small(seen.select("urn"), total), "urn", "left_anti")
        front = cut(new.select("urn", F.lit(hop).alias("depth"), F.when(F.col("u") == 1, "upstream").otherwise("downstream").alias("side")))
        n = front.count()
        if not n:
            break
        seen, total = seen.union(front), total + n
    return seen.where("depth > 0")


def neighbourhood(edges: DataFrame, nodes: DataFrame, urn: str) -> DataFrame:
    """Incident edges of the urn with the other end's name."""
    other = F.when(F.col("source_urn") == urn, F.col("target_urn")).otherwise(F.col("source_urn"))
    near = edges.where((F.col("source_urn") == urn) | (F.col("target_urn") == urn)).withColumn("other_urn", other)
    return near.join(nodes.select(F.col("urn").alias("other_urn"), "display_name"), "other_urn").select("id", "edge_type", "other_urn", "display_name")


def trace_at_level(pairs: DataFrame, closure: DataFrame, nodes: DataFrame, urn: str, level: int, up_depth: int, down_depth: int) -> DataFrame:
    """urn, side, depth over rolled-up pairs (with source_level, target_level) between nodes of the level, from
    the urn's anchor.

    Up and down have frontiers of their own but share what was visited; in a hop, up goes first. A side
    stops at its first empty frontier. Only pairs of the level are read, and small frontiers are broadcast."""
    own = cut(pairs.where((F.col("source_level") == level) & (F.col("target_level") == level)).select("source_urn", "target_urn"))  # every hop reads it
    start = cut(anchor_of(closure, nodes, urn, level))
    seen, total = start.select("urn", F.lit("start").alias("side"), F.lit(0).alias("depth")), start.count()
    fronts = {"upstream": (start, total), "downstream": (start, total)}
    for hop in range(1, max(up_depth, down_depth) + 1):
        for side, most in (("upstream", up_depth), ("downstream", down_depth)):
            front, n = fronts[side]
            if hop <= most and n:
                new = arcs(own, side).join(small(front.select(F.col("urn").alias("at")), n), "at").select(F.col("to").alias("urn")).distinct()
                new = cut(new.join(small(seen.select("urn"), total), "urn", "left_anti"))
                n = new.count()
                fronts[side], total = (new, n), total + n
                seen = seen.union(new.select("urn", F.lit(side).alias("side"), F.lit(hop).alias("depth")))
    return seen


def hop_pairs(pairs: DataFrame, types: list[str] | None) -> DataFrame:
    """Rolled-up pairs that a hop may take: those made of one of the types; all, where none are given."""
    return pairs.where(F.arrays_overlap(F.split("edge_types", ","), F.array(*map(F.lit, types)))) if types else pairs


def with_lineage_or_ancestor(edges: DataFrame, closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """urn, anchor, dist: the nearest of the node and its ancestors that is an end of an edge; nodes with none are left out."""
    ends = edges.select(F.col("source_urn").alias("ancestor_urn")).union(edges.select("target_urn")).distinct()
    found = with_self(closure, nodes).join(ends, "ancestor_urn", "left_semi")
    return found.groupBy("urn").agg(F.min_by("ancestor_urn", F.struct("dist", "ancestor_urn")).alias("anchor"), F.min("dist").alias("dist"))


def with_lineage_in(edges: DataFrame, ups: DataFrame) -> DataFrame:
    """with_lineage_or_ancestor of chains (urn, level, above: urn, level, dist): only nodes that are no end look at what they lie in."""
    ends = edges.select(F.col("source_urn").alias("urn")).union(edges.select("target_urn")).distinct()
    known = ups.select("urn", "above").join(ends.withColumn("end", F.lit(True)), "urn", "left")
    up = known.where("end IS NULL").select("urn", F.explode("above").alias("x")).select("urn", F.col("x.urn").alias("ancestor_urn"), F.col("x.dist").alias("dist"))
    found = up.join(ends.withColumnRenamed("urn", "ancestor_urn"), "ancestor_urn", "left_semi").groupBy("urn").agg(F.min_by("ancestor_urn", F.struct("dist", "ancestor_urn")).alias("anchor"), F.min("dist").alias("dist"))
    return known.where("end").select("urn", F.col("urn").alias("anchor"), F.lit(0).alias("dist")).union(found)


def starts_or_parents(edges: DataFrame, containment: DataFrame, starts: DataFrame, direction: str) -> DataFrame:
    """The starts that have an edge in the direction, and the parents of the others: whose lineage they inherit."""
    own = starts.join(arcs(edges, direction).select(F.col("at").alias("urn")).distinct(), "urn", "left_semi")
    others = starts.join(own, "urn", "left_anti").select(F.col("urn").alias("child_urn"))
    return own.select("urn").union(containment.join(others, "child_urn", "left_semi").select(F.col("parent_urn").alias("urn"))).distinct()


def within_budget(reached: DataFrame, max_nodes: int) -> DataFrame:
    """urn, depth, truncated: the nearest nodes (then by urn), and whether there were more than may be shown."""
    first = reached.orderBy("depth", "urn").limit(max_nodes + 1)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("depth", "urn"))  # max_nodes + 1 rows at most
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    return first.select("urn", "depth", rank.alias("r"), (n > max_nodes).alias("truncated")).where(F.col("r") <= max_nodes).drop("r")


def expand_pair(edges: DataFrame, closure: DataFrame, nodes: DataFrame, source: str, target: str, level: int) -> DataFrame:
    """Pairs of the level's descendants of source and target with an edge between them (rolled up or raw)."""
    s, t = (descendants_at_level(closure, nodes, x, level).select("urn") for x in (source, target))
    return edges.join(s.withColumnRenamed("urn", "source_urn"), "source_urn", "left_semi").join(t.withColumnRenamed("urn", "target_urn"), "target_urn", "left_semi").select("source_urn", "target_urn").distinct()


def has_lineage_at_level(pairs: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """Whether each node of the level has a rolled-up edge (with source_level, target_level) to or from another of it."""
    at = nodes.where(F.col("level") == level).select("urn")
    own = pairs.where((F.col("source_level") == level) & (F.col("target_level") == level))
    ends = own.select(F.col("source_urn").alias("urn")).union(own.select("target_urn")).distinct()
    return at.join(ends.withColumn("has", F.lit(True)), "urn", "left").select("urn", F.coalesce("has", F.lit(False)).alias("has_lineage"))


def incident_edges(edges: DataFrame, start: DataFrame, direction: str, depth: int) -> DataFrame:
    """Edges that a transitive walk takes: those that leave the start or a reached node in the direction; `both`: those of
    a walk down and of a walk up, each once."""
    if direction == "both":
        return incident_edges(edges, start, "downstream", depth).union(incident_edges(edges, start, "upstream", depth)).dropDuplicates(["id"])
    reached = reach(edges, start, direction, depth).select("urn").union(start.select("urn"))
    side = "target_urn" if direction == "upstream" else "source_urn"
    return edges.join(reached.select(F.col("urn").alias(side)).distinct(), side, "left_semi").select(edges.columns)
