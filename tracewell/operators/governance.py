"""Definitions suggested from statistics, digests, level requests, grouping by name, discovery jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suggested(observed: DataFrame, existing: DataFrame, defaults: DataFrame) -> DataFrame:
    """type_id, n, level, origin of each observed type (type_id, n): its existing definition
    (type_id, level), else the default one, else a generic one without a level."""
    own = existing.select("type_id", F.col("level").alias("own_level"), F.lit(True).alias("own"))
    preset = defaults.select("type_id", F.col("level").alias("preset_level"), F.lit(True).alias("preset"))
    origin = F.when(F.col("own"), "existing").when(F.col("preset"), "default").otherwise("generic")
    level = F.when(F.col("own"), F.col("own_level")).otherwise(F.col("preset_level"))
    return observed.join(own, "type_id", "left").join(preset, "type_id", "left").select("type_id", "n", level.alias("level"), origin.alias("origin"))


def digest(definitions: DataFrame, fields: list[str]) -> DataFrame:
    """digest: SHA-256 of the definitions' fields in one order, whatever the order of rows. Definitions
    are one row a type, so one row can hold them; null fields count as empty."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    return definitions.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"))


def resolved_levels(requests: DataFrame, nodes: DataFrame, types: DataFrame) -> DataFrame:
    """urn, spec, level of requests (urn, spec): an integer is the level itself, a type id (types: type_id,
    level) is that type's level, anything else the node's own level; 0 where there is no node."""
    own = nodes.select("urn", F.col("level").alias("own_level"))
    named = types.select(F.col("type_id").alias("spec"), F.col("level").alias("type_level"))
    literal = F.expr("try_cast(spec AS int)")
    level = F.coalesce(literal, F.col("type_level"), F.col("own_level"), F.lit(0))
    return requests.join(own, "urn", "left").join(named, "spec", "left").select("urn", "spec", level.alias("level"))


def _stripped(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[ _-]", "")


def organised(nodes: DataFrame, name: str, groups: list[str]) -> DataFrame:
    """nodes with group_name, score and band: the best of groups (a parameter, tried per row without a
    join): 100 for the same name, 75 where either contains the other, ties to the group named first.
    Null where none fits."""
    own = _stripped(F.col(name))

    def scored(i: int, group: str) -> Column:
        key = _stripped(F.lit(group))
        fits = F.when(own == "", 0).when(own == key, 100).when(own.contains(key) | key.contains(own), 75).otherwise(0)
        return F.struct(F.coalesce(fits, F.lit(0)).alias("score"), F.lit(-i).alias("order"), F.lit(group).alias("name"))

    best = F.array_max(F.array(*[scored(i, g) for i, g in enumerate(groups)]))
    out = nodes.withColumn("best", F.when(best["score"] > 0, best))
    band = F.when(F.col("best.score") >= 80, "high").when(F.col("best.score") >= 50, "medium").when(F.col("best.score") >= 30, "low")
    return out.select("*", F.col("best.name").alias("group_name"), F.col("best.score").alias("score"), band.alias("band")).drop("best")


def discovery(providers: DataFrame, assets: DataFrame, claimed: DataFrame) -> DataFrame:
    """kind, enqueued, deduplicated: a list job for each active provider (provider_id, active) and an asset
    job for each named asset (provider_id, asset) of those; jobs that claimed (kind, provider_id, asset) has
    are deduplicated."""
    active = providers.where("active").select("provider_id")
    lists = active.select(F.lit("list").alias("kind"), "provider_id", F.lit("").alias("asset"))
    named = assets.where("asset <> ''").join(active, "provider_id", "left_semi").select(F.lit("asset").alias("kind"), "provider_id", "asset")
    held = claimed.select("kind", "provider_id", "asset").distinct().withColumn("held", F.lit(True))
    both = lists.union(named).distinct().join(held, ["kind", "provider_id", "asset"], "left")
    return both.groupBy("kind").agg(F.count_if(F.col("held").isNull()).alias("enqueued"), F.count("held").alias("deduplicated"))


def edge_definitions(edges: DataFrame, known: DataFrame) -> DataFrame:
    """edge_type, n, label, is_known of the types met in edges; known: type_id. The label is the type in
    words, each with a capital."""
    met = edges.groupBy("edge_type").agg(F.count("*").alias("n"))
    ids = known.select(F.col("type_id").alias("edge_type"), F.lit(True).alias("is_known")).distinct()
    return met.join(ids, "edge_type", "left").select("edge_type", "n", F.initcap(F.translate("edge_type", "_", " ")).alias("label"), F.coalesce("is_known", F.lit(False)).alias("is_known"))


def roles_in_use(bindings: DataFrame, scope_id: int) -> DataFrame:
    """role, n, subjects of the bindings (subject_type, subject_id, role, scope_id) of one scope."""
    return bindings.where(F.col("scope_id") == scope_id).groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("subject_type", "subject_id").alias("subjects"))
