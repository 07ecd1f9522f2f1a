"""Scope filters: trees of predicates over nodes, and many urn patterns matched at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.hierarchy import with_self
from tracewell.operators.nodes import tag_filter
from tracewell.sources.shared import small

LEAVES = ("urn_patterns", "root_urns", "include_tags", "exclude_tags", "entity_types")


def matched(urns: DataFrame, patterns: DataFrame) -> DataFrame:
    """urn, pattern: each urn with each of the globs (column pattern; `*` any text, `?` one character, case ignored) that fits it.

    A glob's head is what comes before its first wildcard. Urns are looked up by their beginnings, one for each length
    that a head has, in a table of heads: what a trie would do, as one equality join for any number of patterns. Globs
    that are a head and `*`, or have no wildcard, are decided by that; of the others, only those whose head fits are
    run as expressions. A glob without a head is run on every urn."""
    p = F.lower("pattern")
    head = F.regexp_extract(p, r"^[^*?]*", 0)
    rest = F.substr(p, F.length(head) + 1)
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"([\\.\[\]{}()+^$|])", r"\\$1"), r"\*", ".*"), r"\?", ".")
    globs = patterns.select("pattern").distinct().select("pattern", head.alias("head"), F.when(rest == "", "equal").when(rest == "*", "head").otherwise("glob").alias("kind"), F.concat(F.lit("(?s)^"), body, F.lit("$")).alias("expression"))
    lengths = sorted(r[0] for r in globs.select(F.length("head")).distinct().collect())  # as many as the longest head has characters, at most
    if not lengths:
        return urns.select("urn", F.lit("").alias("pattern")).limit(0)
    lower = F.lower("urn")
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(lower)), lambda n: F.substr(lower, F.lit(1), n))
    asked = urns.select("urn", F.explode(heads).alias("head"))
    met = asked.join(small(globs, globs.count()), "head")
    fits = F.when(F.col("kind") == "head", True).when(F.col("kind") == "equal", lower == F.col("head")).otherwise(F.rlike(lower, F.col("expression")))
    return met.where(fits).select("urn", "pattern").distinct()


def compound(urn_patterns=(), root_urns=(), include_tags=(), exclude_tags=(), entity_types=(), mode: str = "or") -> dict:
    """The tree of one flat filter: its parts are alternatives, or must all hold (mode `and`). Excluded tags exclude in
    either mode. Empty parts don't count; an empty filter takes all."""
    parts = [{k: list(v)} for k, v in (("urn_patterns", urn_patterns), ("root_urns", root_urns), ("include_tags", include_tags), ("entity_types", entity_types)) if v]
    tree = {"all" if mode == "and" or not parts else "any": parts}
    return {"all": [tree, {"exclude_tags": list(exclude_tags)}]} if exclude_tags else tree


def scoped(nodes: DataFrame, closure: DataFrame, tree: dict) -> DataFrame:
    """The nodes that a tree takes: {"all": [trees]}, {"any": [trees]}, {"not": tree}, or a leaf: {"urn_patterns": globs},
    {"root_urns": urns} (those and all they contain), {"include_tags": tags} and {"exclude_tags": tags} (any of them),
    {"entity_types": types}. An empty `all` takes every node, an empty `any` none.

    Tags and types become one expression. Patterns and roots become tables of urns, each joined once as a mark,
    whatever the tree is like; a node with marks for none of them stays in the table."""
    marks: list[DataFrame] = []
    spark = nodes.sparkSession

    def mark(urns: DataFrame) -> Column:
        marks.append(urns.select("urn", F.lit(True).alias(f"mark{len(marks)}")))
        return F.coalesce(F.col(f"mark{len(marks) - 1}"), F.lit(False))

    def table(values: list[str], name: str) -> DataFrame:
        return spark.createDataFrame([(v,) for v in values], f"{name} string")

    def built(t: dict) -> Column:
        (kind, value), *more = t.items()
        if more:
            raise ValueError(f"one key for each tree, not {sorted(t)}")
        if kind in ("all", "any"):
            return reduce(lambda a, b: a & b if kind == "all" else a | b, map(built, value), F.lit(kind == "all"))
        if kind == "not":
            return ~built(value)
        if kind == "urn_patterns":
            return mark(matched(nodes, table(value, "pattern")).select("urn").distinct())
        if kind == "root_urns":
            inside = with_self(closure, table(value, "urn")).join(table(value, "ancestor_urn"), "ancestor_urn", "left_semi")
            return mark(inside.select("urn").distinct())
        if kind == "entity_types":
            return F.coalesce(F.col("entity_type").isin(value), F.lit(False))
        if kind in ("include_tags", "exclude_tags"):
            return F.coalesce(tag_filter("any", value) if kind == "include_tags" else tag_filter("none", value), F.lit(kind == "exclude_tags"))
        raise ValueError(f"no leaf {kind}; there are {LEAVES}")

    keep = built(tree)
    out = nodes
    for m in marks:
        out = out.join(m, "urn", "left")
    return out.where(keep).select(nodes.columns)
