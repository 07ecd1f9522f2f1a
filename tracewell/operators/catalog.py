"""Catalogue of views: facets, rankings, search, permissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.scalar import match_score
from tracewell.sources.shared import cut, small


def facet(views: DataFrame, value: Column) -> DataFrame:
    return views.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def popular(views: DataFrame, favourites: DataFrame, limit: int) -> DataFrame:
    """view_id, n: the views with most favourites; each user counts once."""
    n = favourites.distinct().groupBy("view_id").agg(F.count("*").alias("n"))
    return views.select("view_id").join(n, "view_id").orderBy(F.desc("n"), "view_id").limit(limit)


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the highest version of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")


def duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All but the first row of each key."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("r > 1").drop("r")


def search_scored(rows: DataFrame, term: str, weights: dict[str, int], key: str, limit: int) -> DataFrame:
    """key, score: weighted best matches of a term over several columns."""
    score = reduce(lambda a, b: a + b, [match_score(F.col(c), term) * w for c, w in weights.items()])
    return rows.select(key, score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def top_per(rows: DataFrame, category: str, order: list, n: int) -> DataFrame:
    by = Window.partitionBy(category)
    return rows.withColumn("pos", F.row_number().over(by.orderBy(*order))).where(F.col("pos") <= n)


def permissions(bindings: DataFrame, members: DataFrame, granted: DataFrame) -> DataFrame:
    """user_id, scope_id, permission: from bindings (subject_type, subject_id, role, scope_id) of users and of
    their groups, and the roles' permissions. A permission `x:*` stands for all of x; what it covers is left out."""
    direct = bindings.where("subject_type = 'user'").select(F.col("subject_id").alias("user_id"), "role", "scope_id")
    via = bindings.where("subject_type = 'group'").join(members.select(F.col("group_id").alias("subject_id"), "user_id"), "subject_id").select("user_id", "role", "scope_id")
    out = direct.union(via).distinct().join(granted, "role").select("user_id", "scope_id", "permission").distinct()
    group = F.substring_index("permission", ":", 1)
    wild = out.where(F.col("permission").endswith(":*")).select("user_id", "scope_id", group.alias("group"))
    rest = out.where(~F.col("permission").endswith(":*")).withColumn("group", group).join(wild, ["user_id", "scope_id", "group"], "left_anti")
    return rest.select(*out.columns).union(out.where(F.col("permission").endswith(":*")))


def permission_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    keys = ["user_id", "scope_id", "permission"]
    both = before.select(*keys, F.lit(1).alias("b")).join(after.select(*keys, F.lit(1).alias("a")), keys, "full")
    return both.where("a is null or b is null").select(*keys, F.when(F.col("b").isNull(), "gained").otherwise("lost").alias("change"))


def job_summary(jobs: DataFrame) -> DataFrame:
    """status, n, success (completed of completed and failed, in %, over all jobs)."""
    done, failed = F.sum(F.when(F.col("status") == "completed", F.col("n")).otherwise(0)), F.sum(F.when(F.col("status") == "failed", F.col("n")).otherwise(0))
    by = jobs.groupBy("status").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))  # a row for each status
    return by.withColumn("success", F.round(100.0 * done.over(every) / (done.over(every) + failed.over(every)), 1))


def view_stats(views: DataFrame, attention: Column, recent_days: int) -> DataFrame:
    """One row: views, those updated of late, those that need attention, the least age; in one pass."""
    return views.agg(F.count("*").alias("total"), F.count_if(F.col("age_days") <= recent_days).alias("recent"), F.count_if(attention).alias("attention"), F.min("age_days").alias("newest"))


def entity_search(entities: DataFrame, term: str, cap: int, limit: int) -> DataFrame:
    """entity_type, id, score (3 equal, 2 prefix, 1 inside): at most cap of each type, limit in all."""
    v, t = F.lower("name"), term.lower()
    found = entities.withColumn("score", F.when(v == t, 3).when(v.startswith(t), 2).when(v.contains(t), 1)).where("score is not null")
    capped = top_per(found, "entity_type", [F.desc("score"), F.col("name"), F.col("id")], cap)
    return capped.orderBy(F.desc("score"), "name", "entity_type", "id").limit(limit).select("entity_type", "id", "score")


#: Parts that each group's values are dealt into, to find the one that holds a rank.
SLOTS = 100


def nearest_rank(values: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """group, value at index int(n * p / 100) of its sorted values, exactly; nulls don't count.

    Approximate quantiles deal a group's values into SLOTS; their counts tell which slot holds the index, and
    only that one's values, equal ones as one row, are put in order. So a task sorts about a hundredth of a group."""
    own = values.select(F.col(group).alias("g"), F.col(value).alias("v")).where("v is not null")
    marks = [i / SLOTS for i in range(1, SLOTS)]
    # Kept, as another computation might give other quantiles.
    groups = cut(own.groupBy(F.col("g").alias("k")).agg(F.percentile_approx("v", marks).alias("marks"), F.count("*").alias("n")))
    slot = F.size(F.filter("marks", lambda m: m < F.col("v")))
    dealt = own.join(small(groups, groups.count()), F.col("g").eqNullSafe(F.col("k"))).select("g", "v", "n", slot.alias("slot"))
    upto = F.sum("m").over(Window.partitionBy("g").orderBy("slot"))
    sizes = dealt.groupBy("g", "n", "slot").agg(F.count("*").alias("m")).withColumn("upto", upto)
    at = F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1) - (F.col("upto") - F.col("m"))
    held = cut(sizes.withColumn("i", at).where("i >= 0 AND i < m").select(F.col("g").alias("k"), F.col("slot").alias("s"), "i"))
    picked = dealt.join(small(held, held.count()), F.col("g").eqNullSafe(F.col("k")) & (F.col("slot") == F.col("s"))).groupBy("g", "i", "v").agg(F.count("*").alias("m"))
    ranked = picked.withColumn("upto", F.sum("m").over(Window.partitionBy("g").orderBy("v")))
    return ranked.where("i >= upto - m AND i < upto").select(F.col("g").alias(group), F.col("v").alias("value"))
