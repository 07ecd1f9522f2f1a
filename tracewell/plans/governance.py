"""Queries over definitions, level requests, grouping by name and discovery jobs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import governance, ontology
from tracewell.plans.administration import _BINDINGS, _bindings
from tracewell.plans.catalogue import Tables, query
from tracewell.plans.sql import EDGES, NODES

GROUPS = ["United States", "china", "united", "IA", "peru-lima"]


def _types(t: Tables) -> DataFrame:
    return ontology.tables(t.spark)[0]


def _values(rows: list) -> str:
    return ", ".join(f"('{name}', {level})" for name, level, *_ in rows)


@query(f"o AS (SELECT entity_type AS type_id, COUNT(*) AS n FROM nodes GROUP BY 1), d(type_id, level) AS (VALUES {_values(ontology.ENTITY_TYPES)}) SELECT type_id, n, CASE type_id WHEN 'column' THEN NULL ELSE d.level END AS level, CASE WHEN type_id IN ('domain', 'system') THEN 'existing' WHEN type_id = 'column' THEN 'generic' ELSE 'default' END AS origin FROM o LEFT JOIN d USING (type_id)", NODES)
def suggested_types(t):
    observed = t.nodes.groupBy(F.col("entity_type").alias("type_id")).agg(F.count("*").alias("n"))
    known = _types(t)
    return governance.suggested(observed, known.where("type_id in ('domain', 'system')"), known.where("type_id <> 'column'"))


@query("k AS (SELECT entity_type, level, COUNT(*) AS n FROM nodes GROUP BY 1, 2) SELECT SHA256(STRING_AGG(entity_type || '|' || level || '|' || n, CHR(10) ORDER BY entity_type || '|' || level || '|' || n)) AS digest FROM k", NODES)
def type_digest(t):
    return governance.digest(t.nodes.groupBy("entity_type", "level").agg(F.count("*").alias("n")), ["entity_type", "level", "n"])


@query(f"d(type_id, type_level) AS (VALUES {_values(ontology.ENTITY_TYPES)}), r AS (SELECT 'urn:lg:tpch:dataset:p' || (1 + user_id) AS urn, CASE event_id % 5 WHEN 0 THEN 'auto' WHEN 1 THEN '2' WHEN 2 THEN 'system' WHEN 3 THEN event_type END AS spec FROM events) SELECT r.urn, r.spec, COALESCE(TRY_CAST(r.spec AS INTEGER), type_level, n.level, 0) AS level FROM r LEFT JOIN d ON d.type_id = r.spec LEFT JOIN nodes n ON n.urn = r.urn", NODES)
def requested_levels(t):
    kind = F.col("event_id") % 5
    spec = F.when(kind == 0, "auto").when(kind == 1, "2").when(kind == 2, "system").when(kind == 3, F.col("event_type"))
    requests = t.read("events").select(F.concat(F.lit("urn:lg:tpch:dataset:p"), (1 + F.col("user_id")).cast("string")).alias("urn"), spec.alias("spec"))
    return governance.resolved_levels(requests, t.nodes, _types(t))


_GROUPS = ", ".join(f"({i}, '{g}')" for i, g in enumerate(GROUPS))
_KEY = "REGEXP_REPLACE(LOWER({}), '[ _-]', '', 'g')"


@query(f"g(i, g) AS (VALUES {_GROUPS}), s AS (SELECT n_nationkey, i, g, CASE WHEN a = b THEN 100 WHEN CONTAINS(a, b) OR CONTAINS(b, a) THEN 75 END AS score FROM (SELECT n_nationkey, i, g, {_KEY.format('n_name')} AS a, {_KEY.format('g')} AS b FROM nation, g)), w AS (SELECT * FROM s WHERE score IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY n_nationkey ORDER BY score DESC, i) = 1) SELECT n_nationkey, n_name, g AS group_name, score, CASE score WHEN 100 THEN 'high' WHEN 75 THEN 'medium' END AS band FROM nation LEFT JOIN w USING (n_nationkey)")
def organised_names(t):
    return governance.organised(t.read("nation").select("n_nationkey", "n_name"), "n_name", GROUPS)


@query("a AS (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0), j AS (SELECT DISTINCT 'list' AS kind, s_suppkey AS p, '' AS asset FROM a UNION SELECT 'asset', ps, asset FROM (SELECT l_suppkey AS ps, CASE l_partkey % 4 WHEN 0 THEN '' ELSE 'part-' || l_partkey END AS asset FROM lineitem) WHERE asset <> '' AND ps IN (SELECT s_suppkey FROM a)), c AS (SELECT DISTINCT 'asset' AS kind, l_suppkey AS p, 'part-' || l_partkey AS asset FROM lineitem WHERE l_quantity > 25 UNION SELECT 'list', s_suppkey, '' FROM supplier WHERE s_nationkey < 9) SELECT j.kind, COUNT(*) FILTER (c.p IS NULL) AS enqueued, COUNT(*) FILTER (c.p IS NOT NULL) AS deduplicated FROM j LEFT JOIN c ON c.kind = j.kind AND c.p = j.p AND c.asset = j.asset GROUP BY 1")
def discovery_jobs(t):
    s, items = t.read("supplier"), t.read("lineitem")
    part = F.concat(F.lit("part-"), F.col("l_partkey").cast("string"))
    assets = items.select(F.col("l_suppkey").alias("provider_id"), F.when(F.col("l_partkey") % 4 == 0, "").otherwise(part).alias("asset"))
    claimed = items.where("l_quantity > 25").select(F.lit("asset").alias("kind"), F.col("l_suppkey").alias("provider_id"), part.alias("asset"))
    claimed = claimed.union(s.where("s_nationkey < 9").select(F.lit("list"), "s_suppkey", F.lit("")))
    return governance.discovery(s.select(F.col("s_suppkey").alias("provider_id"), (F.col("s_acctbal") >= 0).alias("active")), assets, claimed)


@query("SELECT edge_type, COUNT(*) AS n, CASE edge_type WHEN 'PRODUCES' THEN 'Produces' WHEN 'FLOWS_TO' THEN 'Flows To' ELSE 'Derived From' END AS label, edge_type <> 'FLOWS_TO' AS is_known FROM edges GROUP BY 1", EDGES)
def edge_type_definitions(t):
    return governance.edge_definitions(t.edges, ontology.tables(t.spark)[1].where("type_id <> 'FLOWS_TO'"))


@query(f"{_BINDINGS} SELECT role, COUNT(*) AS n, COUNT(DISTINCT subject_type || ':' || subject_id) AS subjects FROM b WHERE scope_id = 1 GROUP BY 1")
def roles_of_scope(t):
    return governance.roles_in_use(_bindings(t), 1)
