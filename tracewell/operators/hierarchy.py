"""Containment: closure, chains, pages of children, levels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.sources.shared import cut

MAX_DEPTH = 10


def closure(containment: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """urn, ancestor_urn, dist (1 .. max_depth, the shortest). Cycles end at max_depth.

    One join per level of the hierarchy; the loop stops at its top, so there are as many as it is deep."""
    step = cut(containment.select(F.col("child_urn").alias("urn"), F.col("parent_urn").alias("ancestor_urn")).distinct())
    up = step.select(F.col("urn").alias("ancestor_urn"), F.col("ancestor_urn").alias("next"))
    out, now = step.withColumn("dist", F.lit(1)), step
    for dist in range(2, max_depth + 1):
        now = cut(now.join(up, "ancestor_urn").select("urn", F.col("next").alias("ancestor_urn")).distinct())
        if now.isEmpty():
            break
        out = out.union(now.withColumn("dist", F.lit(dist)))
    return out.groupBy("urn", "ancestor_urn").agg(F.min("dist").alias("dist"))


def with_self(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    return closure.union(nodes.select("urn", F.col("urn").alias("ancestor_urn"), F.lit(0).alias("dist")))


def children(nodes: DataFrame, containment: DataFrame, parent: str) -> DataFrame:
    own = containment.where(F.col("parent_urn") == parent).select(F.col("child_urn").alias("urn"))
    return nodes.join(own, "urn", "left_semi")


def parents(containment: DataFrame) -> DataFrame:
    return containment.groupBy(F.col("child_urn").alias("urn")).agg(F.min("parent_urn").alias("parent_urn"))


def roots(nodes: DataFrame, containment: DataFrame) -> DataFrame:
    """Nodes in no other node."""
    return nodes.join(containment.select(F.col("child_urn").alias("urn")), "urn", "left_anti")


def root_counts(nodes: DataFrame, containment: DataFrame, root_types: list[str]) -> DataFrame:
    is_root = F.col("entity_type").isin(root_types)
    return roots(nodes, containment).agg(F.count_if(is_root).alias("root_count"), F.count_if(~is_root).alias("orphan_count"))


def chains(closure: DataFrame) -> DataFrame:
    """urn, chain (ancestors from the parent to the root, at most MAX_DEPTH)."""
    one = closure.groupBy("urn", "dist").agg(F.min("ancestor_urn").alias("a"))
    return one.groupBy("urn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dist", "a"))), lambda x: x["a"]), ">").alias("chain"))


def descendants(closure: DataFrame, urn: str, depth: int = 5, nodes: DataFrame | None = None, types: list[str] | None = None) -> DataFrame:
    """urn, dist of what a node contains; with nodes and types only those of the types (others are passed through on the way)."""
    out = closure.where((F.col("ancestor_urn") == urn) & (F.col("dist") <= depth)).select("urn", "dist")
    return out if types is None else out.join(nodes.where(F.col("entity_type").isin(types)).select("urn"), "urn", "left_semi")


def descendants_at_level(closure: DataFrame, nodes: DataFrame, urn: str, level: int) -> DataFrame:
    """Nodes of the level among the urn and what it contains."""
    below = closure.where(F.col("ancestor_urn") == urn).select("urn")
    at = nodes.where(F.col("level") == level)
    return at.join(below, "urn", "left_semi").union(at.where(F.col("urn") == urn)).select("urn", "entity_type", "display_name")


def anchors_at_level(closure: DataFrame, nodes: DataFrame, level: int, of: DataFrame | None = None) -> DataFrame:
    """urn, anchor: the nearest of the node and its ancestors that is of the level, else the node itself; for the
    nodes of a table, or for all."""
    asked = nodes if of is None else of
    at = nodes.where(F.col("level") == level).select(F.col("urn").alias("ancestor_urn"))
    found = with_self(closure, asked).join(at, "ancestor_urn", "left_semi").groupBy("urn").agg(F.min_by("ancestor_urn", F.struct("dist", "ancestor_urn")).alias("anchor"))
    return asked.select("urn").join(found, "urn", "left").select("urn", F.coalesce("anchor", "urn").alias("anchor"))


def anchor_of(closure: DataFrame, nodes: DataFrame, urn: str, level: int) -> DataFrame:
    """urn: the anchor of one node, as anchors_at_level has it for all; no row for an unknown node."""
    node = nodes.where(F.col("urn") == urn)
    return anchors_at_level(closure.where(F.col("urn") == urn), nodes, level, node).select(F.col("anchor").alias("urn"))


def anchors_at_granularity(closure: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """urn, anchor: the first on the way up whose level is no finer than the given one, else the node."""
    at = nodes.where(F.col("level") <= level).select(F.col("urn").alias("ancestor_urn"))
    found = with_self(closure, nodes).join(at, "ancestor_urn", "left_semi").groupBy("urn").agg(F.min_by("ancestor_urn", F.struct("dist", "ancestor_urn")).alias("anchor"))
    return nodes.select("urn").join(found, "urn", "left").select("urn", F.coalesce("anchor", "urn").alias("anchor"))


def ancestry(closure: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """urn, at0 .. at<levels - 1>: the nearest of each node and its ancestors at each level (null: none), to be stored
    once; a question about anchors then reads the columns it needs and joins nothing else."""
    at = nodes.select(F.col("urn").alias("ancestor_urn"), F.col("level").alias("own"))
    up = with_self(closure, nodes).join(at, "ancestor_urn")
    nearest = [F.min_by(F.when(F.col("own") == n, F.col("ancestor_urn")), F.when(F.col("own") == n, F.struct("dist", "ancestor_urn"))).alias(f"at{n}") for n in range(levels)]
    return up.groupBy("urn").agg(*nearest)


def first_in(chain: Column, fits: Callable[[Column], Column], farthest: bool = False) -> Column:
    """Of a chain (urn, level, dist, the node itself included) the urn that is nearest, or farthest, of those that fit, then smallest (farthest:
    largest); else the node."""
    order = F.transform(F.filter(chain, fits), lambda x: F.struct(x["dist"].alias("dist"), x["urn"].alias("urn")))
    node = F.get(F.filter(chain, lambda x: x["dist"] == 0), F.lit(0))["urn"]
    return F.coalesce((F.array_max if farthest else F.array_min)(order)["urn"], node)


def anchors_in(ups: DataFrame, level: int) -> DataFrame:
    """anchors_at_granularity of chains (urn, level, above), row by row."""
    own = F.array(F.struct("urn", "level", F.lit(0).alias("dist")))
    return ups.select("urn", first_in(F.concat(own, "above"), lambda x: x["level"] <= level).alias("anchor"))


def ancestry_of(ups: DataFrame, levels: int) -> DataFrame:
    """ancestry of chains (urn, level, above: urn, level, dist of all above the node), row by row."""
    own = F.array(F.struct(F.lit(0).alias("dist"), "urn", "level"))
    chain = F.concat(own, F.transform("above", lambda x: F.struct(x["dist"].alias("dist"), x["urn"].alias("urn"), x["level"].alias("level"))))
    up = ups.select("urn", F.array_sort(chain).alias("chain"))
    return up.select("urn", *[F.get(F.filter("chain", lambda x, n=n: x["level"] == n), F.lit(0))["urn"].alias(f"at{n}") for n in range(levels)])


def anchors_by(ancestry: DataFrame, level: int) -> DataFrame:
    """urn, anchor, as anchors_at_granularity has it where levels rise on the way down."""
    return ancestry.select("urn", F.coalesce(*[F.col(f"at{n}") for n in range(level, -1, -1)], "urn").alias("anchor"))


def closing_moves(closure: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (child_urn, new_parent_urn) with closes_cycle: whether the new parent is in the child, or is it."""
    inside = closure.select(F.col("urn").alias("new_parent_urn"), F.col("ancestor_urn").alias("child_urn"), F.lit(True).alias("inside"))
    return moves.join(inside, ["child_urn", "new_parent_urn"], "left").select("child_urn", "new_parent_urn", (F.coalesce("inside", F.lit(False)) | (F.col("child_urn") == F.col("new_parent_urn"))).alias("closes_cycle"))


def root_of(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    top = closure.groupBy("urn").agg(F.max_by("ancestor_urn", F.struct("dist", "ancestor_urn")).alias("root"))
    return nodes.select("urn").join(top, "urn", "left").select("urn", F.coalesce("root", "urn").alias("root"))


def ordered_ancestors(closure: DataFrame, nodes: DataFrame, urn: str) -> DataFrame:
    return closure.where(F.col("urn") == urn).select(F.col("ancestor_urn").alias("urn"), "dist").join(nodes, "urn").select("urn", "dist", "entity_type", "display_name")


def first_children(nodes: DataFrame, containment: DataFrame, n: int) -> DataFrame:
    """The first n children of every parent by name and urn, with the parent's child count."""
    named = containment.join(nodes.select(F.col("urn").alias("child_urn"), "display_name"), "child_urn")
    by = Window.partitionBy("parent_urn")
    return named.withColumn("pos", F.row_number().over(by.orderBy("display_name", "child_urn"))).where(F.col("pos") <= n).select("parent_urn", "pos", "child_urn")
