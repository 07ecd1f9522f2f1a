"""Ontology tables: resolution, coverage, drift, containment rules, checks of mutations.

entity_types: type_id, level, can_contain array<string>. rel_types: type_id, is_containment, is_lineage,
source_types, target_types arrays (empty: any)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "type_id string, level int, can_contain array<string>"
RELATION = "type_id string, is_containment boolean, is_lineage boolean, source_types array<string>, target_types array<string>"
ENTITY_TYPES = [("domain", 0, ["system"]), ("system", 1, ["container"]), ("dataPlatform", 1, ["dataset"]), ("container", 2, ["dataset"]), ("dataset", 3, ["column"]), ("column", 4, [])]
REL_TYPES = [("CONTAINS", True, False, [], []), ("PRODUCES", False, True, ["container"], ["dataset"]), ("FLOWS_TO", False, True, ["dataset"], ["column"]), ("DERIVED_FROM", False, True, ["dataset"], ["dataset"]), ("TAGGED_WITH", False, False, [], [])]


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(ENTITY_TYPES, ENTITY), spark.createDataFrame(REL_TYPES, RELATION)


def resolve(*layers: tuple[str, DataFrame]) -> DataFrame:
    """Definitions by type_id (case ignored): the last layer that has a type wins. Adds `source`."""
    out = None
    for rank, (name, types) in enumerate(layers):
        now = types.withColumn("source", F.lit(name)).withColumn("rank", F.lit(rank))
        out = now if out is None else out.unionByName(now)
    best = out.groupBy(F.lower("type_id").alias("key")).agg(F.max_by(F.struct(*[c for c in out.columns if c != "rank"]), "rank").alias("d"))
    return best.select("d.*")


def coverage(found: DataFrame, known: DataFrame) -> DataFrame:
    """One row: covered, uncovered, extra, percent (100 where nothing was found)."""
    both = found.select(F.col("type_id"), F.lit(1).alias("f")).distinct().join(known.select("type_id", F.lit(1).alias("k")).distinct(), "type_id", "full")
    n = F.count("f")
    covered = F.count_if(F.col("f").isNotNull() & F.col("k").isNotNull())
    return both.agg(covered.alias("covered"), (n - covered).alias("uncovered"), F.count_if(F.col("f").isNull()).alias("extra"), F.when(n == 0, 100.0).otherwise(F.round(100.0 * covered / n, 1)).alias("percent"))


def drift(external: DataFrame, known: DataFrame) -> DataFrame:
    """type_id, suggestion: external types that are not known (case ignored), and the known type that starts most alike (case,
    `_` and `-` ignored; of several the last by name), if the first character is the same.

    Each known type goes with all its beginnings, so an external one meets those that share a beginning, and no others."""
    new = external.select("type_id").distinct().join(known.select(F.upper("type_id").alias("u")), F.upper("type_id") == F.col("u"), "left_anti")
    plain = F.lower(F.regexp_replace("type_id", "[_-]", ""))
    head = F.explode(F.transform(F.sequence(F.lit(0), F.length(plain)), lambda n: F.substr(plain, F.lit(1), n))).alias("head")
    longest = known.select(F.col("type_id").alias("known_id"), head).where("head <> ''").groupBy("head").agg(F.max("known_id").alias("known_id"))
    asked = new.select("type_id", head).where("head <> ''")
    best = asked.join(longest, "head").groupBy("type_id").agg(F.max_by("known_id", F.length("head")).alias("suggestion"))
    return new.join(best, "type_id", "left").select("type_id", "suggestion")


def impact(old: DataFrame, new: DataFrame) -> DataFrame:
    a, b = old.select("type_id", F.lit(1).alias("o")), new.select("type_id", F.lit(1).alias("n"))
    return a.join(b, "type_id", "full").where("o is null or n is null").select("type_id", F.when(F.col("o").isNull(), "added").otherwise("removed").alias("change"))


def type_closure(types: DataFrame, max_depth: int = 10) -> DataFrame:
    """type_id, inner_id, dist: what a type contains, directly or through others."""
    step = types.select(F.col("type_id"), F.explode("can_contain").alias("inner_id"))
    out, now = step.withColumn("dist", F.lit(1)), step
    for dist in range(2, max_depth + 1):
        now = now.join(step.select(F.col("type_id").alias("inner_id"), F.col("inner_id").alias("next")), "inner_id").select("type_id", F.col("next").alias("inner_id")).distinct()
        if now.isEmpty():
            break
        out = out.union(now.withColumn("dist", F.lit(dist)))
    return out.groupBy("type_id", "inner_id").agg(F.min("dist").alias("dist"))


def containment_cycles(types: DataFrame) -> DataFrame:
    """Types that contain themselves through another type."""
    return type_closure(types).where("type_id = inner_id and dist > 1").select("type_id")


def type_hierarchy(nodes: DataFrame, containment: DataFrame) -> DataFrame:
    """parent_type, child_type, n as they are in the graph."""
    t = nodes.select("urn", "entity_type")
    both = containment.join(t.select(F.col("urn").alias("parent_urn"), F.col("entity_type").alias("parent_type")), "parent_urn").join(t.select(F.col("urn").alias("child_urn"), F.col("entity_type").alias("child_type")), "child_urn")
    return both.groupBy("parent_type", "child_type").agg(F.count("*").alias("n"))


def allowed_children(types: DataFrame, parent: str) -> DataFrame:
    """Every type with whether the parent may contain it; allowed ones first."""
    rule = types.where(F.col("type_id") == parent).agg(F.first("can_contain").alias("rule"))  # one row
    none = F.array().cast("array<string>")
    allowed = F.when(F.size("rule") == 0, True).otherwise(F.array_contains(F.coalesce("rule", none), F.col("type_id")))
    return types.select("type_id").join(F.broadcast(rule)).select("type_id", allowed.alias("allowed")).orderBy(F.desc("allowed"), "type_id")


def derived_types(nodes: DataFrame, containment: DataFrame) -> DataFrame:
    """type_id, can_contain (sorted), root (in no other type), as the graph has them."""
    seen = type_hierarchy(nodes, containment).where("parent_type <> child_type")
    inner = seen.groupBy(F.col("parent_type").alias("type_id")).agg(F.array_join(F.sort_array(F.collect_set("child_type")), ",").alias("can_contain"))
    child = seen.select(F.col("child_type").alias("type_id"), F.lit(False).alias("root")).distinct()
    return nodes.select(F.col("entity_type").alias("type_id")).distinct().join(inner, "type_id", "left").join(child, "type_id", "left").select("type_id", F.coalesce("can_contain", F.lit("")).alias("can_contain"), F.coalesce("root", F.lit(True)).alias("root"))


def check_nodes(nodes: DataFrame, containment: DataFrame, types: DataFrame) -> DataFrame:
    """urn, entity_type, error (null where valid): unknown type, or a parent that may not contain it (an
    empty list of can_contain allows all)."""
    parent = containment.join(nodes.select(F.col("urn").alias("parent_urn"), F.col("entity_type").alias("parent_type")), "parent_urn").select(F.col("child_urn").alias("urn"), "parent_type")
    known = types.select(F.lower("type_id").alias("k"), F.lit(True).alias("known"))
    rules = types.select(F.col("type_id").alias("parent_type"), F.col("can_contain").alias("rule"))
    met = nodes.join(known, F.lower("entity_type") == F.col("k"), "left").join(parent, "urn", "left").join(rules, "parent_type", "left")
    barred = (F.size("rule") > 0) & ~F.array_contains("rule", F.col("entity_type"))
    return met.select("urn", "entity_type", F.when(F.col("known").isNull(), "unknown type").when(barred, "parent may not contain it").alias("error"))


def schema_merge(types: DataFrame, stats: DataFrame) -> DataFrame:
    """type_id, defined, n: the ontology's types and those of the graph (type_id, n), each once."""
    return types.select("type_id", F.lit(True).alias("d")).join(stats, "type_id", "full").select("type_id", F.coalesce("d", F.lit(False)).alias("defined"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def check_edges(edges: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """id, error (null where the edge is valid): unknown type, or an end of a type that is not allowed."""
    t = nodes.select("urn", "entity_type")
    e = edges.join(t.select(F.col("urn").alias("source_urn"), F.col("entity_type").alias("st")), "source_urn", "left").join(t.select(F.col("urn").alias("target_urn"), F.col("entity_type").alias("tt")), "target_urn", "left")
    r = relations.select(F.upper("type_id").alias("rt"), "source_types", "target_types")
    bad = lambda types, x: (F.size(types) > 0) & ~F.coalesce(F.array_contains(types, F.col(x)), F.lit(False))
    return e.join(r, F.upper("edge_type") == F.col("rt"), "left").select("id", "edge_type", F.when(F.col("rt").isNull(), "unknown type").when(bad("source_types", "st"), "source not allowed").when(bad("target_types", "tt"), "target not allowed").alias("error"))
