"""Role bindings: who has a role and through what, counts, previews of a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.catalog import permission_changes


def bindings_per_role(bindings: DataFrame) -> DataFrame:
    return bindings.groupBy("role").agg(F.count("*").alias("n"))


def explained(bindings: DataFrame, members: DataFrame) -> DataFrame:
    """user_id, role, scope_id, via (`direct` or `group`), groups: through how many groups."""
    direct = bindings.where("subject_type = 'user'").select(F.col("subject_id").alias("user_id"), "role", "scope_id", F.lit("direct").alias("via"), F.lit(None).cast("long").alias("group_id"))
    groups = bindings.where("subject_type = 'group'").withColumnRenamed("subject_id", "group_id").join(members, "group_id")
    return direct.union(groups.select("user_id", "role", "scope_id", F.lit("group"), "group_id")).groupBy("user_id", "role", "scope_id", "via").agg(F.count_distinct("group_id").alias("groups"))


def users_of_role(bindings: DataFrame, members: DataFrame, role: str) -> DataFrame:
    return explained(bindings.where(F.col("role") == role), members).select("user_id").distinct()


def preview(before: DataFrame, after: DataFrame) -> DataFrame:
    """user_id, change, permissions, scopes: what each user gains and loses; others are left out."""
    changed = permission_changes(before, after)
    return changed.groupBy("user_id", "change").agg(F.array_join(F.array_sort(F.collect_set("permission")), ",").alias("permissions"), F.count_distinct("scope_id").alias("scopes"))


def readable(views: DataFrame, members: DataFrame, grants: DataFrame, user: int) -> DataFrame:
    """view_id, via: views (view_id, created_by, visibility, workspace_id) that the user may read, and the
    first reason: own, public, member (of the workspace), grant."""
    ours = members.where(F.col("user_id") == user).select("workspace_id", F.lit(True).alias("is_member")).distinct()
    given = grants.where(F.col("user_id") == user).select("view_id", F.lit(True).alias("is_granted")).distinct()
    marked = views.join(ours, "workspace_id", "left").join(given, "view_id", "left")
    via = F.when(F.col("created_by") == user, "own").when(F.col("visibility") == "public", "public").when((F.col("visibility") == "workspace") & F.col("is_member"), "member").when(F.col("is_granted"), "grant")
    return marked.select("view_id", via.alias("via")).where("via is not null")


def may(action: str, own: Column, permitted: Column, editor: Column) -> Column:
    """Whether a view may be edited (by an editor grant, too), deleted, or restored."""
    return own | permitted | editor if action == "edit" else own | permitted


def multi_version(rows: DataFrame, schema: str, version: str) -> DataFrame:
    """Schemas that are deployed at more than one version."""
    return rows.groupBy(schema).agg(F.count_distinct(version).alias("versions")).where("versions > 1")
