"""Assignment of nodes to layers by instances, inheritance and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalar import glob_regex
from tracewell.operators.hierarchy import root_of, with_self
from tracewell.sources.shared import cut, small


def best_rules(nodes: DataFrame, rules: list[dict]) -> DataFrame:
    """urn, layer: of the rules of which type, tag or glob matches, the one with the highest priority, then the first.

    rules: layer, priority and any of entity_types, tags, urn_pattern. They are few and become one expression."""
    hit = F.lit(None).cast("string")
    for rule in sorted(enumerate(rules), key=lambda r: (-r[1]["priority"], r[0]), reverse=True):
        r = rule[1]
        match = F.lit(False)
        if r.get("entity_types"):
            match = match | F.col("entity_type").isin(r["entity_types"])
        if r.get("tags"):
            match = match | F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, r["tags"])))
        if r.get("urn_pattern"):
            match = match | F.col("urn").rlike(glob_regex(r["urn_pattern"]))
        hit = F.when(match, r["layer"]).otherwise(hit)
    return nodes.select("urn", hit.alias("layer"))


def assign(nodes: DataFrame, closure: DataFrame, rules: list[dict], instances: DataFrame, first_layer: str) -> DataFrame:
    """urn, layer, confidence, inherited. The nearest of the node and its ancestors with an instance decides;
    else the rule of the root, else the first layer with confidence 0.5. So all but roots inherit."""
    given = cut(instances.select(F.col("urn").alias("ancestor_urn"), F.col("layer").alias("given")))
    given = small(given, given.count())
    own = with_self(closure, nodes).join(given, "ancestor_urn").groupBy("urn").agg(F.min_by("given", F.struct("dist", "ancestor_urn")).alias("given"), F.min("dist").alias("dist"))
    tops = nodes.join(closure.select("urn").distinct(), "urn", "left_anti")  # rules matter for roots alone
    by_root = root_of(closure, nodes).join(best_rules(tops, rules).select(F.col("urn").alias("root"), F.col("layer").alias("rule")), "root")
    return by_root.join(own, "urn", "left").select("urn", F.coalesce("given", "rule", F.lit(first_layer)).alias("layer"), F.when(F.col("given").isNotNull() | F.col("rule").isNotNull(), 1.0).otherwise(0.5).alias("confidence"), F.when(F.col("given").isNotNull(), F.col("dist") > 0).otherwise(F.col("urn") != F.col("root")).alias("inherited"))


def visual_roots(assigned: DataFrame, containment: DataFrame) -> DataFrame:
    """Nodes whose parent is in another layer, or that have none."""
    up = containment.select(F.col("child_urn").alias("urn"), "parent_urn").join(assigned.select(F.col("urn").alias("parent_urn"), F.col("layer").alias("parent_layer")), "parent_urn")
    return assigned.join(up.select("urn", "parent_layer"), "urn", "left").where("parent_layer is null or parent_layer <> layer").select("urn", "layer")


def conflicts(instances: DataFrame, closure: DataFrame) -> DataFrame:
    """urn, other_urn: instances in another layer than that of an instance above them."""
    above = closure.join(instances.select("urn", "layer"), "urn").join(instances.select(F.col("urn").alias("ancestor_urn"), F.col("layer").alias("upper")), "ancestor_urn")
    return above.where("layer <> upper").select("urn", F.col("ancestor_urn").alias("other_urn"))
