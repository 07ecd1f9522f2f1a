"""Lineage rollup: every edge counts for each pair of (its source or an ancestor, its target or an ancestor)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.sources.shared import BROADCAST_ROWS, cut, small


def contributions(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """source_urn, target_urn, edge_id, edge_type: the pairs each edge counts for; ends that meet are no pair."""
    up = closure.select("urn", "ancestor_urn")
    own = lambda side: edges.select(F.col("id").alias("edge_id"), F.col(side).alias("urn"))
    ends = lambda side, name: own(side).join(up, "urn").select("edge_id", F.col("ancestor_urn").alias(name)).union(own(side))
    pairs = ends("source_urn", "source_urn").join(ends("target_urn", "target_urn"), "edge_id").where("source_urn <> target_urn")
    return pairs.join(edges.select(F.col("id").alias("edge_id"), "edge_type"), "edge_id").select("source_urn", "target_urn", "edge_id", "edge_type")


def typed(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """source_urn, target_urn, edge_type, n: how many edges of each type a pair stands for. An edge id counts once.

    Edges are joined with the chain of one end, summed, and joined with the chain of the other: very many edges
    meet in the same (ancestor, target), which keeps the second join small."""
    up = closure.select("urn", "ancestor_urn")
    own = edges.dropDuplicates(["id"]).select("source_urn", "target_urn", "edge_type")
    src = own.join(up.select(F.col("urn").alias("source_urn"), F.col("ancestor_urn").alias("s")), "source_urn").select(F.col("s").alias("source_urn"), "target_urn", "edge_type").union(own)
    half = src.groupBy("source_urn", "target_urn", "edge_type").agg(F.count("*").alias("n"))
    both = half.join(up.select(F.col("urn").alias("target_urn"), F.col("ancestor_urn").alias("t")), "target_urn").select("source_urn", F.col("t").alias("target_urn"), "edge_type", "n").union(half.select("source_urn", "target_urn", "edge_type", "n"))
    return both.where("source_urn <> target_urn").groupBy("source_urn", "target_urn", "edge_type").agg(F.sum("n").alias("n"))


def folded(typed: DataFrame) -> DataFrame:
    """source_urn, target_urn, weight (edges), edge_types (sorted) of typed counts."""
    return typed.groupBy("source_urn", "target_urn").agg(F.sum("n").alias("weight"), F.array_join(F.sort_array(F.collect_set("edge_type")), ",").alias("edge_types"))


def rollup(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """The pairs that the edges and their containment make."""
    return folded(typed(edges, closure))


def linked(targeted: DataFrame, chains: DataFrame) -> DataFrame:
    """targeted edges (source_urn, target_urn, edge_type, targets, more) with source_level, sources (urn, level, dist of all above the
    source) and alone: whether no other source lies in this one, so that its own pairs are of its edges alone. Rows lie together by source.

    chains: urn, level, holds, above. No array is made anew here: Spark shuffles linked edges once for several readers only if their
    plans are equal, and takes lambdas for different."""
    up = chains.select(F.col("urn").alias("source_urn"), F.col("level").alias("source_level"), "holds", "above")
    none = F.array().cast(chains.schema["above"].dataType)
    # An edge without a source makes no pair; said here, as a filter that Spark would infer for some readers alone makes them shuffle apart.
    return targeted.where("source_urn IS NOT NULL").repartition("source_urn").join(up, "source_urn", "left").select(*targeted.columns, "source_level", F.coalesce("above", none).alias("sources"), (~F.coalesce("holds", F.lit(True))).alias("alone"))


def contributed(linked: DataFrame, own: bool) -> DataFrame:
    """source_urn, source_level, target_urn, target_level, edge_type, n: the pairs of linked edges (n: 1, or a column), either those
    that sources which are alone make themselves, or all others; ends that meet are no pair.

    The former stay where linked edges lie, and are summed there."""
    n = F.col("n") if "n" in linked.columns else F.lit(1)
    self = F.array(F.struct(F.col("source_urn").alias("urn"), F.col("source_level").alias("level"), F.lit(0).alias("dist")))
    if own:
        # sources are named in both parts, so that they read the same columns and Spark shuffles linked edges once for both.
        each = linked.where(F.col("alone") & (F.size("sources") >= 0)).select("source_urn", "source_level", "edge_type", n.alias("n"), F.explode("targets").alias("t"))
    else:
        sources = F.when(F.col("alone"), F.col("sources")).otherwise(F.concat("sources", self))
        each = linked.select("edge_type", n.alias("n"), "targets", F.explode(sources).alias("s"))
        each = each.select(F.col("s.urn").alias("source_urn"), F.col("s.level").alias("source_level"), "edge_type", "n", F.explode("targets").alias("t"))
    return each.select("source_urn", "source_level", F.col("t.urn").alias("target_urn"), F.col("t.level").alias("target_level"), "edge_type", "n").where("source_urn <> target_urn")


def typed_of(linked: DataFrame) -> DataFrame:
    """typed counts of linked edges."""
    sums = lambda each: each.groupBy("source_urn", "target_urn", "edge_type").agg(F.sum("n").alias("n")).where("n > 0")
    return sums(contributed(linked, True)).union(sums(contributed(linked, False)))


def pairs_of(linked: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """source_urn, target_urn, weight, edge_types, source_level, target_level of linked edges, which are of the given types.

    Counts by type lie side by side in a row, so pairs are shuffled once at most; one whose counts are none is no pair."""
    other = F.when(F.col("edge_type").isin(*types), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("unknown edge type "), "edge_type")).cast("int"))
    of = [F.sum(F.when(F.col("edge_type") == k, other).otherwise(0)).alias(f"n{i}") for i, k in enumerate(sorted(types))]
    of += [F.sum(other).alias("weight")]
    sums = lambda each: each.groupBy("source_urn", "source_level", "target_urn", "target_level").agg(*of).where("weight > 0")
    names = F.concat_ws(",", *[F.when(F.col(f"n{i}") > 0, k) for i, k in enumerate(sorted(types))])
    both = sums(contributed(linked, True)).union(sums(contributed(linked, False)))
    return both.select("source_urn", "target_urn", "weight", names.alias("edge_types"), "source_level", "target_level")


def changed(targeted: DataFrame, others: DataFrame, chains: DataFrame, types: tuple[str, ...], sign: int) -> DataFrame:
    """source_urn, target_urn, weight, edge_types of the pairs of targeted edges after others are added (sign 1) or deleted (-1).

    An edge that is there already counts once when added, and one that isn't there is not deleted. Nothing is stored that a delta could be
    put on (see with_edges and without_edges for that): what is left is counted in one pass. Rows of one edge meet where all edges are
    dealt by their source anyway."""
    key = ["source_urn", "edge_type", "target_urn"]
    first = F.first("targets").alias("targets")
    here = F.max(F.when(F.col("old"), 1).otherwise(0)) == 1
    both = targeted.select("source_urn", "edge_type", "targets", F.lit(True).alias("old")).union(others.select("source_urn", "edge_type", "targets", F.lit(False)))
    each = both.where("source_urn IS NOT NULL").repartition("source_urn").withColumn("target_urn", F.get("targets", F.lit(0))["urn"]).groupBy(*key).agg(first, here.alias("was"), F.max(~F.col("old")).alias("named"))
    left = each.where("was OR named") if sign > 0 else each.where("was AND NOT named")
    return pairs_of(linked(left.select(*key, "targets"), chains), types).select("source_urn", "target_urn", "weight", "edge_types")


def with_levels(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs with source_level and target_level; null where an end is no node."""
    at = lambda side: nodes.select(F.col("urn").alias(f"{side}_urn"), F.col("level").alias(f"{side}_level"))
    return pairs.join(at("source"), "source_urn", "left").join(at("target"), "target_urn", "left").select(*pairs.columns, "source_level", "target_level")


def tops(closure: DataFrame, nodes: DataFrame, level: int, inside: DataFrame | None = None) -> DataFrame:
    """urn, top: each node's ancestors of the level, itself included; only those inside a table of urns, if given."""
    at = nodes.where(F.col("level") == level).select(F.col("urn").alias("top"))
    at = at if inside is None else at.join(inside.select(F.col("urn").alias("top")), "top", "left_semi")
    return closure.select("urn", F.col("ancestor_urn").alias("top")).join(at, "top", "left_semi").select("urn", "top").union(at.select(F.col("top").alias("urn"), "top"))


def at_levels(edges: DataFrame, closure: DataFrame, nodes: DataFrame, source_level: int, target_level: int, sources: DataFrame | None = None) -> DataFrame:
    """source_urn, target_urn, weight of the pairs between two levels alone, without those of other levels;
    only from the given sources (urn), if any."""
    s = tops(closure, nodes, source_level, sources).select(F.col("urn").alias("source_urn"), F.col("top").alias("s"))
    t = tops(closure, nodes, target_level).select(F.col("urn").alias("target_urn"), F.col("top").alias("t"))
    own = edges.join(s, "source_urn").dropDuplicates(["id", "s"]).groupBy("s", "target_urn").agg(F.count("*").alias("n"))
    return own.join(t, "target_urn").where("s <> t").groupBy(F.col("s").alias("source_urn"), F.col("t").alias("target_urn")).agg(F.sum("n").alias("weight"))


def with_edges(before: DataFrame, edges: DataFrame, added: DataFrame, closure: DataFrame) -> DataFrame:
    """typed counts after edges are added to those of before; one that was there already counts once.

    Only the pairs of new edges are made; the others pass by, without a shuffle while those of new edges are few."""
    return shifted(before, typed(added.join(edges.select("id"), "id", "left_anti"), closure))


def without_edges(before: DataFrame, edges: DataFrame, deleted: DataFrame, closure: DataFrame) -> DataFrame:
    """typed counts after edges (column id) are deleted: counts fall, and pairs at none go."""
    gone = edges.join(deleted.select("id"), "id", "left_semi")
    return shifted(before, typed(gone, closure).withColumn("n", -F.col("n")))


def shifted(before: DataFrame, delta: DataFrame) -> DataFrame:
    """typed counts of before and delta; those at none go. Counts that delta doesn't name stay as they are."""
    keys, delta = ["source_urn", "target_urn", "edge_type"], cut(delta)
    n = delta.count()
    if n > BROADCAST_ROWS:  # both sides meet once
        both = before.select(*keys, "n").join(delta.select(*keys, F.col("n").alias("change")), keys, "full")
        return both.select(*keys, (F.coalesce("n", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("n")).where("n > 0")
    named = small(delta.select(keys), n)
    changed = before.join(named, keys, "left_semi").select(*keys, "n").union(delta.select(*keys, "n")).groupBy(keys).agg(F.sum("n").alias("n")).where("n > 0")
    return before.join(named, keys, "left_anti").select(*keys, "n").union(changed)


def between(pairs: DataFrame, sources: list[str], targets: list[str] | None = None) -> DataFrame:
    out = pairs.where(F.col("source_urn").isin(sources))
    return out.where(F.col("target_urn").isin(targets)) if targets else out


def listed_between(pairs: DataFrame, sources: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """source_urn, target_urn, weight (1 where unknown), edge_types, total of the pairs between two tables of urns (or from the first to
    any), the heaviest first; total is the weight of all of them."""
    own = pairs.join(sources.select(F.col("urn").alias("source_urn")).distinct(), "source_urn", "left_semi")
    own = own if targets is None else own.join(targets.select(F.col("urn").alias("target_urn")).distinct(), "target_urn", "left_semi")
    own = cut(own.where("source_urn <> target_urn").select("source_urn", "target_urn", F.coalesce("weight", F.lit(1)).alias("weight"), "edge_types"))
    total = own.agg(F.sum("weight")).first()[0] or 0
    return own.select("*", F.lit(total).cast("long").alias("total")).orderBy(F.desc("weight"), "source_urn", "target_urn")


def anchored(edges: DataFrame, anchor: DataFrame, *by: str) -> DataFrame:
    """source_urn, target_urn, by..., n, confidence: edges counted between the anchors (urn, anchor) of their ends, with their highest
    confidence (null is 1); edges with a common anchor are left out.

    Edges are summed when their source has its anchor, so that far fewer rows meet the anchors of targets."""
    one = F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence")
    s = edges.join(anchor.select(F.col("urn").alias("source_urn"), F.col("anchor").alias("s")), "source_urn")
    half = s.groupBy("s", "target_urn", *by).agg(F.count("*").alias("n"), one)
    both = half.join(anchor.select(F.col("urn").alias("target_urn"), F.col("anchor").alias("t")), "target_urn").where("s <> t")
    return both.groupBy(F.col("s").alias("source_urn"), F.col("t").alias("target_urn"), *by).agg(F.sum("n").alias("n"), F.max("confidence").alias("confidence"))


def at_granularity(anchored: DataFrame) -> DataFrame:
    """source_urn, target_urn, n, confidence: edges between the anchors of their ends (see anchored); five edges are sure."""
    return anchored.withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 5.0))


def bundles(anchored: DataFrame) -> DataFrame:
    """Edges projected on visible anchors (see anchored, by edge_type): count, types, highest confidence (null is 1)."""
    return anchored.groupBy("source_urn", "target_urn").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_set("edge_type")), ",").alias("edge_types"), F.max("confidence").alias("confidence"), (F.sum("n") > 1).alias("bundled"))


def projected(targeted: DataFrame, chains: DataFrame, anchor: Callable[[Column], Column], *by: str) -> DataFrame:
    """What anchored() makes of targeted edges (rows: copies), for anchors that follow from a node's chain (urn, level, dist, the node
    itself included) alone; edges of which an end is no node are left out.

    The anchors of targets are known before any shuffle, so edges are summed before they meet their sources."""
    one = F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence")
    known = targeted.where(F.get("targets", F.lit(0))["level"].isNotNull())
    half = known.select("source_urn", anchor(F.col("targets")).alias("t"), *by, "copies", "confidence").groupBy("source_urn", "t", *by).agg(F.sum("copies").alias("n"), one)
    own = F.array(F.struct("urn", "level", F.lit(0).alias("dist")))
    at = chains.select(F.col("urn").alias("source_urn"), anchor(F.concat(own, "above")).alias("s"))
    both = half.join(at, "source_urn").where("s <> t")
    return both.groupBy(F.col("s").alias("source_urn"), F.col("t").alias("target_urn"), *by).agg(F.sum("n").alias("n"), F.max("confidence").alias("confidence"))


def visible_anchors(closure: DataFrame, nodes: DataFrame, expanded: DataFrame) -> DataFrame:
    """urn, anchor: the coarsest of the node and its ancestors that is not in the expanded set, else the node."""
    up = closure.join(expanded.select(F.col("urn").alias("ancestor_urn")), "ancestor_urn", "left_anti")
    top = up.groupBy("urn").agg(F.max_by("ancestor_urn", F.struct("dist", "ancestor_urn")).alias("anchor"))
    return nodes.select("urn").join(top, "urn", "left").select("urn", F.coalesce("anchor", "urn").alias("anchor"))
