"""Views as a catalogue: health, filters, enrichment, counts, impact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.sources.shared import stored

STALE_DAYS = 90


def with_sources(views: DataFrame, workspaces: DataFrame, sources: DataFrame) -> DataFrame:
    """views with workspace_name, workspace_active, source_name, source_active; null where missing."""
    return views.join(workspaces, "workspace_id", "left").join(sources, "data_source_id", "left")


def health() -> Column:
    """Of a row of with_sources that has age_days: the first that holds."""
    broken = lambda c: F.col(c).isNull()
    return (
        F.when(broken("workspace_active"), "broken").when(~F.col("workspace_active"), "warning")
        .when(broken("source_active"), "broken").when(~F.col("source_active"), "warning")
        .when(F.col("age_days") > STALE_DAYS, "stale").otherwise("healthy")
    )


def chosen(one, several) -> list | None:
    """The values that a filter asks for: several win over one; empty ones ask for nothing."""
    return list(several) if several else [one] if one else None


#: Columns of view_filter() that take a value (under the column's name) or several (under this name).
EQUAL = {"visibility": "visibility_in", "workspace_id": "workspace_ids", "context_model_id": "context_model_ids", "data_source_id": "data_source_ids", "view_type": "view_types", "created_by": "created_by_in"}
#: Columns that a search looks into.
SEARCHED = ["name", "description", "workspace_name", "source_name", "created_by", "tags"]


def view_filter(*, deleted: str = "no", favourited_only: bool = False, created_after: str | None = None, tags: list[str] | None = None, search: str = "", attention_only: bool = False, **equal) -> Column:
    """One predicate over rows of with_sources() with deleted_at, created_at, tags (a JSON list as text), is_favourited and what
    EQUAL and SEARCHED name: all parts that are asked for hold.

    deleted: `no`, `too` or `only`. Several values win over one. created_after is included. Tags are alternatives, matched as
    quoted words, case ignored. search: part of any of SEARCHED, case ignored. attention_only: see health()."""
    unknown = set(equal) - set(EQUAL) - set(EQUAL.values())
    if unknown:
        raise ValueError(f"no filter {sorted(unknown)}")
    gone = F.col("deleted_at").isNotNull()
    parts = [{"no": ~gone, "only": gone, "too": F.lit(True)}[deleted]]
    parts += [F.col(c).isin(v) for c, many in EQUAL.items() if (v := chosen(equal.get(c), equal.get(many)))]
    parts += [F.col("is_favourited")] * favourited_only + ([F.col("created_at") >= created_after] if created_after else [])
    quoted = [F.lower("tags").contains(f'"{t.lower()}"') for t in tags or []]
    parts += [reduce(lambda a, b: a | b, quoted)] if quoted else []
    parts += ([any_contains(SEARCHED, search)] if search else []) + [needs_attention()] * attention_only
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in parts])


def listed(views: DataFrame, keep: Column, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    """The rows of a page, with pos (from 1 in the whole list), total, has_more and next_offset.

    One scan: the filtered rows are range-partitioned by the order and counted by partition; a row's place is that within its
    partition and what comes before, so neither the count nor the sort brings all rows to one task."""
    kept = views.where(keep)
    dealt = stored(kept.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id()).sortWithinPartitions(*order), "listed")
    counts = dealt.groupBy("chunk").agg(F.count("*").alias("n"))
    before = counts.select("chunk", F.coalesce(F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))  # a row for each partition
    near = dealt.join(F.broadcast(before.where((F.col("before") < offset + limit))), "chunk")
    pos = F.col("before") + F.row_number().over(Window.partitionBy("chunk").orderBy(*order))
    page = near.withColumn("pos", pos).where((F.col("pos") > offset) & (F.col("pos") <= offset + limit))
    more = F.col("total") > offset + limit
    return page.select(*views.columns, F.col("pos").cast("long").alias("pos"), "total", more.alias("has_more"), F.when(more, F.lit(offset + limit)).alias("next_offset"))


def needs_attention() -> Column:
    return health() != "healthy"


def any_contains(columns: list[str], term: str) -> Column:
    """Whether one of the columns holds the term, case ignored; an empty term is no filter."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False)) for c in columns]) if term else F.lit(True)


def enriched(views: DataFrame, favourites: DataFrame, user: int) -> DataFrame:
    """views with favourite_count and is_favourited (by the user)."""
    n = favourites.distinct().groupBy("view_id").agg(F.count("*").alias("favourite_count"), F.max(F.col("user_id") == user).alias("is_favourited"))
    return views.join(n, "view_id", "left").withColumns({"favourite_count": F.coalesce("favourite_count", F.lit(0).cast("long")), "is_favourited": F.coalesce("is_favourited", F.lit(False))})


def counts(views: DataFrame) -> DataFrame:
    """Views of each workspace, of each data source, and in all, in one pass."""
    w, s = F.col("workspace_id"), F.col("data_source_id")
    return views.groupingSets([[w], [s], []], w, s).agg(F.count("*").alias("n"))


def impact(views: DataFrame, workspaces: DataFrame, owner: str) -> DataFrame:
    """Workspaces and views that depend on each owner (a column of workspaces)."""
    return workspaces.join(views, "workspace_id", "left").groupBy(owner).agg(F.count_distinct("workspace_id").alias("workspaces"), F.count_distinct("view_id").alias("views"))
