"""Predicates, pages and counts on nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_LEVEL = ("urn", "entity_type", "display_name", "level")


def field(name: str) -> Column:
    """A node's own attribute if there is one of the name, else its property."""
    return F.col(name) if name in TOP_LEVEL else F.col("properties")[name]


def property_filter(name: str, op: str, value=None) -> Column:
    """equals contains startsWith endsWith gt lt in notIn exists notExists; null fails all but notExists."""
    f = field(name)
    text = F.lower(f.cast("string"))
    if op in ("gt", "lt"):
        number = f.try_cast("double")
        out = (number > value if op == "gt" else number < value) if isinstance(value, int | float) else F.lit(False)
    elif op in ("in", "notIn"):
        out = (f.isin(value) if op == "in" else ~f.isin(value)) if isinstance(value, list) else F.lit(False)
    else:
        out = {"equals": lambda: f == value, "contains": lambda: text.contains(str(value).lower()), "startsWith": lambda: text.startswith(str(value).lower()), "endsWith": lambda: text.endswith(str(value).lower()), "exists": f.isNotNull, "notExists": f.isNull}[op]()
    return F.coalesce(out, F.lit(False))


def tag_filter(mode: str, wanted: list[str]) -> Column:
    tags, w = F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, wanted)).cast("array<string>")
    return {"any": F.arrays_overlap(tags, w), "all": F.size(F.array_except(w, tags)) == 0, "none": ~F.arrays_overlap(tags, w)}[mode]


def name_filter(op: str, value: str, case_sensitive: bool = False) -> Column:
    v, n = (value, F.col("display_name")) if case_sensitive else (value.lower(), F.lower("display_name"))
    return F.coalesce({"equals": n == v, "contains": n.contains(v), "startsWith": n.startswith(v), "endsWith": n.endswith(v)}[op], F.lit(False))


def search(text: str) -> Column:
    """Part of the name or the urn, case ignored; an empty text filters nothing."""
    t = text.lower()
    return F.coalesce(F.lower("display_name").contains(t) | F.lower("urn").contains(t), F.lit(False)) if t else F.lit(True)


def query(nodes: DataFrame, *predicates: Column, offset: int = 0, limit: int | None = 100) -> DataFrame:
    """Nodes that meet all predicates; pages by name, then urn. limit None: all of them."""
    out = nodes.where(reduce(lambda a, b: a & b, predicates, F.lit(True)))
    return out if limit is None else out.orderBy("display_name", "urn").offset(offset).limit(limit)


def keyset_page(nodes: DataFrame, after: tuple[str, str] | None, limit: int) -> DataFrame:
    """The page after (display_name, urn): no row is lost where names are equal."""
    more = nodes if after is None else nodes.where(F.struct("display_name", "urn") > F.struct(*map(F.lit, after)))
    return more.orderBy("display_name", "urn").limit(limit)


def child_counts(nodes: DataFrame, containment: DataFrame) -> DataFrame:
    n = containment.groupBy(F.col("parent_urn").alias("urn")).agg(F.count("*").alias("child_count"))
    return nodes.join(n, "urn", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0).cast("long")))


def distinct_values(nodes: DataFrame, name: str, limit: int = 100) -> DataFrame:
    v = F.explode("tags") if name == "tags" else field(name)
    return nodes.select(v.alias("value")).where("value is not null").distinct().orderBy("value").limit(limit)


def edge_filter(sources: list[str] | None = None, targets: list[str] | None = None, ends: list[str] | None = None, types: list[str] | None = None, min_confidence: float | None = None) -> Column:
    parts = [F.col("source_urn").isin(sources)] * bool(sources) + [F.col("target_urn").isin(targets)] * bool(targets)
    parts += [F.col("source_urn").isin(ends) | F.col("target_urn").isin(ends)] * bool(ends) + [F.col("edge_type").isin(types)] * bool(types)
    parts += [F.coalesce(F.col("confidence") >= min_confidence, F.lit(False))] * (min_confidence is not None)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def edges_between(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges from the urns of sources to the urns of targets, each id once."""
    out = edges.join(sources.select(F.col("urn").alias("source_urn")), "source_urn", "left_semi").join(targets.select(F.col("urn").alias("target_urn")), "target_urn", "left_semi")
    return out.dropDuplicates(["id"]).select(edges.columns)


def edges_page(edges: DataFrame, offset: int, limit: int) -> DataFrame:
    return edges.orderBy("id").offset(offset).limit(limit)


def hydrated(nodes: DataFrame, urns: DataFrame) -> DataFrame:
    """The nodes of the urns; unknown urns give none."""
    return nodes.join(urns.select("urn").distinct(), "urn", "left_semi")


def envelope(page: DataFrame, offset: int, limit: int) -> DataFrame:
    """One row for a page that was read with limit + 1 rows: rows, has_more, total (as far as known), next_cursor."""
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("display_name", "urn"))  # limit + 1 rows at most
    rows = F.least(F.count("*"), F.lit(limit))
    more = F.count("*") > limit
    return page.withColumn("r", rank).agg(rows.alias("rows"), more.alias("has_more"), (offset + rows + F.when(more, 1).otherwise(0)).alias("total"), F.max_by("display_name", F.when(F.col("r") <= limit, F.col("r"))).alias("next_cursor"))


def lineage_types(whitelist: list[str] | None, containment: list[str]) -> Column:
    """Which edges are rolled up: those of the whitelist (AGGREGATED never is), else all but containment."""
    if whitelist is not None:
        return F.col("edge_type").isin([t for t in whitelist if t != "AGGREGATED"])
    return ~F.col("edge_type").isin([*containment, "AGGREGATED"])


def fingerprint(counts: DataFrame) -> DataFrame:
    """One row: the first 16 hex digits of the SHA-256 of counts (name, n) as JSON with sorted keys."""
    pairs = F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col("name"), F.lit('":'), F.col("n").cast("string"))))
    return counts.agg(F.substring(F.sha2(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")), 256), 1, 16).alias("fingerprint"))


def tag_stats(nodes: DataFrame) -> DataFrame:
    return nodes.select("entity_type", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("entity_type")), ",").alias("entity_types"))
