"""Scalar functions of the graph engine as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """`*` any text, `?` one character, everything else itself; whole text, case ignored."""
    return "(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def sanitise(name: Column, fallback: str) -> Column:
    clean = F.regexp_replace(name, "[^A-Za-z0-9_]", "")
    return F.when(clean == "", F.lit(fallback)).otherwise(clean)


def parse_urn(u: Column) -> dict[str, Column]:
    """Parts of urn:<namespace>:<system>:<type>:<slug>; the slug may hold colons."""
    part = lambda i: F.regexp_extract(u, r"^urn:([^:]+):([^:]+):([^:]+):(.+)$", i)
    return {"namespace": F.lower(part(1)), "source_system": F.lower(part(2)), "entity_type": F.lower(part(3)), "slug": part(4)}


def valid_urn(u: Column) -> Column:
    return F.coalesce(u.rlike("^urn:[^:]+:.+"), F.lit(False))


def humanise(name: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "[_-]+", " "))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, case, `_` and `-` ignored."""
    a, b = (F.lower(F.regexp_replace(x, "[_-]", "")) for x in (a, b))
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    return F.array_max(same)


def age_seconds(ts: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(as_of) - F.unix_timestamp(ts)).cast("long")


def freshness(age: Column) -> Column:
    return F.when(age.isNull() | (age >= 604800), "expired").when(age <= 300, "fresh").otherwise("stale")


def service_health(age: Column) -> Column:
    return F.when(age.isNull(), "unknown").when(age <= 60, "healthy").when(age <= 600, "lagging").otherwise("unreachable")


def match_score(value: Column, term: str) -> Column:
    """100 equal, 60 prefix, 40 start of a word, 20 inside, else 0; case ignored."""
    v, t = F.lower(F.coalesce(value, F.lit(""))), term.lower()
    return F.when(v == t, 100).when(v.startswith(t), 60).when(v.rlike(r"[\s_./-]" + re.escape(t)), 40).when(v.contains(t), 20).otherwise(0)
