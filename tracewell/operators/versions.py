"""Definitions as documents: what differs between two, and their life as a fold of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of nesting that differ() looks into; deeper values are compared as a whole.
DEPTH = 6


def canonical(text: Column) -> Column:
    """JSON with the keys of its objects in order and without spaces, so that equal documents are equal texts; arrays keep their
    order. Null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def import_diff(current: DataFrame, imported: DataFrame, keyed: list[str]) -> DataFrame:
    """id, changed, fields (that differ, in order), added and removed (`field.key` of the fields in `keyed`, whose values are
    objects by type) of each document in both tables (id, field, value as JSON).

    Values are equal if their JSON is, whatever the order of keys. A field that one side lacks, or has as null, is
    an empty text."""
    own = lambda df, name: df.select("id", "field", F.coalesce(canonical(F.col("value")), F.lit("")).alias(name))
    ids = current.select("id").distinct().join(imported.select("id").distinct(), "id", "left_semi")
    both = own(current, "a").join(own(imported, "b"), ["id", "field"], "full").join(ids, "id", "left_semi")
    both = both.select("id", "field", F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"))
    keys = lambda c: F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    named = lambda x, y: F.when(F.col("field").isin(keyed), F.transform(F.array_except(keys(x), keys(y)), lambda k: F.concat("field", F.lit("."), k)))
    differ = F.col("a") != F.col("b")
    joined = lambda c: F.array_join(F.sort_array(F.flatten(F.collect_list(c))), ",")
    return both.groupBy("id").agg(F.max(differ).alias("changed"), F.array_join(F.sort_array(F.collect_list(F.when(differ, F.col("field")))), ",").alias("fields"), joined(named("b", "a")).alias("added"), joined(named("a", "b")).alias("removed"))


def leaves(documents: DataFrame) -> DataFrame:
    """id, path, value: each value of documents (id, value as JSON) that is no object and no array, or an empty one, under its path:
    keys with dots between, positions in brackets. What lies deeper than DEPTH is one value."""
    spark = documents.sparkSession
    now = documents.select("id", F.lit("").alias("path"), F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    out = None
    for _ in range(DEPTH):
        kind = F.schema_of_variant("v")
        inner = (kind.startswith("OBJECT<") & (kind != "OBJECT<>")) | (kind.startswith("ARRAY<") & (F.to_json("v") != "[]"))
        flat = now.where(~inner).select("id", "path", F.to_json("v").alias("value"))
        out = flat if out is None else out.union(flat)
        deep = now.where(inner).withColumn("is_array", F.schema_of_variant("v").startswith("ARRAY<"))
        met = deep.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key"), F.col("value").alias("child")))
        step = F.when(F.col("is_array"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("path") == "", "").otherwise("."), F.col("key")))
        now = met.select("id", F.concat("path", step).alias("path"), F.col("child").alias("v"))
    return out.union(now.select("id", "path", F.to_json("v")))


def differ(current: DataFrame, imported: DataFrame) -> DataFrame:
    """id, path, change (added, removed, changed), old, new: where documents (id, value) of both tables differ."""
    a, b = leaves(current).withColumnRenamed("value", "old"), leaves(imported).withColumnRenamed("value", "new")
    ids = current.select("id").join(imported.select("id"), "id", "left_semi")
    both = a.join(b, ["id", "path"], "full").join(ids, "id", "left_semi").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("id", "path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"), "old", "new")


def lifecycle(events: DataFrame) -> DataFrame:
    """id, seq, action, outcome, version, status, deleted after each event of a document (id, seq, action, content).

    Actions: `import` (content): nothing if it equals the content so far, else in place in a draft, and as a new draft version where
    the last one is published; the first is version 1. `new_version`: a draft with the content so far. `publish`, `delete`,
    `restore`. Before any content the others do nothing (outcome none). Deleted documents take imports as before.

    The fold is windows alone: the content so far is that of the import before, equal or not; the status before an event is set by
    the last one that set it; versions are counted."""
    by = Window.partitionBy("id").orderBy("seq")
    before, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_ = lambda name: F.col("action") == name
    text = F.when(is_("import"), F.coalesce(canonical(F.col("content")), F.col("content"), F.lit("")))
    e = events.withColumn("text", text).withColumn("so_far", F.last("text", ignorenulls=True).over(before))
    known = F.col("so_far").isNotNull()
    e = e.withColumn("fresh", is_("import") & ~F.col("text").eqNullSafe(F.col("so_far")))
    e = e.withColumn("sets", F.when(F.col("fresh") | (is_("new_version") & known), "draft").when(is_("publish") & known, "published"))
    e = e.withColumn("was", F.last("sets", ignorenulls=True).over(before))
    e = e.withColumn("counts", (F.col("fresh") & (~known | (F.col("was") == "published"))) | (is_("new_version") & known))
    e = e.withColumns({"version": F.sum(F.col("counts").cast("int")).over(upto), "status": F.last("sets", ignorenulls=True).over(upto), "deleted": F.coalesce(F.last(F.when(is_("delete") & known, True).when(is_("restore") & known, False), ignorenulls=True).over(upto), F.lit(False))})
    outcome = (
        F.when(is_("import") & ~F.col("fresh"), "no_changes").when(F.col("fresh") & ~known, "created").when(F.col("fresh") & F.col("counts"), "new_draft").when(F.col("fresh"), "updated")
        .when(~known, "none").when(is_("new_version"), "new_version").when(is_("publish"), F.when(F.col("was") == "published", "none").otherwise("published"))
        .when(is_("delete"), "deleted").when(is_("restore"), "restored").otherwise("none")
    )
    return e.select("id", "seq", "action", outcome.alias("outcome"), F.col("version").cast("int").alias("version"), "status", "deleted")
