"""More queries over the graph, its ontology, views and job events, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import scalar
from tracewell.operators import access, catalog, hierarchy, layers, nodes, ontology, traversal, views
from tracewell.plans.administration import _HEALTH, _STATUS, _VIEWS, _full, _orders
from tracewell.plans.catalogue import _ASSIGNED, _GRANTS, _JOBS, DOMAIN, NATION, RULES, SUPPLIER, Tables, _walk, query
from tracewell.plans.sql import ANC, EDGES, NODES, PAIRS
from tracewell.sources import graph
from tracewell.streaming import events as ev
from tracewell.streaming import jobs


@query(f"{_ASSIGNED} SELECT urn FROM assigned WHERE layer = 'raw'", NODES, ANC)
def nodes_of_layer(t):
    return layers.assign(t.nodes, t.closure, RULES, t.instances, "core").where("layer = 'raw'").select("urn")


@query("SELECT DISTINCT urn, display_name FROM nodes WHERE urn IN (SELECT 'urn:lg:tpch:container:c' || user_id FROM events)", NODES)
def nodes_hydrated(t):
    asked = t.read("events").select(F.concat(F.lit("urn:lg:tpch:container:c"), F.col("user_id").cast("string")).alias("urn"))
    return nodes.hydrated(t.nodes, asked).select("urn", "display_name")


@query("SELECT id FROM edges ORDER BY id LIMIT 30 OFFSET 100", EDGES)
def edges_page(t):
    return nodes.edges_page(t.edges, 100, 30).select("id")


@query("SELECT parent_urn, child_urn FROM containment WHERE parent_urn IN (SELECT urn FROM nodes WHERE level <= 2) AND child_urn IN (SELECT urn FROM nodes WHERE level <= 2)", NODES, ANC)
def containment_within(t):
    at = t.nodes.where("level <= 2").select("urn")
    return t.containment.join(at.withColumnRenamed("urn", "parent_urn"), "parent_urn", "left_semi").join(at.withColumnRenamed("urn", "child_urn"), "child_urn", "left_semi").select("parent_urn", "child_urn")


@query("p AS (SELECT n.urn, n.display_name, ROW_NUMBER() OVER (ORDER BY display_name, urn) AS r FROM nodes n JOIN containment c ON c.child_urn = n.urn AND c.parent_urn = 'urn:lg:tpch:domain:1' ORDER BY r LIMIT 4) SELECT LEAST(COUNT(*), 3) AS rows, COUNT(*) > 3 AS has_more, LEAST(COUNT(*), 3) + CASE WHEN COUNT(*) > 3 THEN 1 ELSE 0 END AS total, MAX(display_name) FILTER (r = LEAST(3, (SELECT COUNT(*) FROM p))) AS next_cursor FROM p", NODES, ANC)
def children_envelope(t):
    return nodes.envelope(nodes.query(hierarchy.children(t.nodes, t.containment, DOMAIN), limit=4), 0, 3)


@query("SELECT edge_type, COUNT(*) AS n FROM edges WHERE edge_type IN ('FLOWS_TO', 'PRODUCES') GROUP BY 1", EDGES)
def lineage_whitelist(t):
    return t.edges.where(nodes.lineage_types(["FLOWS_TO", "PRODUCES", "AGGREGATED"], ["CONTAINS"])).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("SELECT SUBSTR(SHA256('{' || STRING_AGG('\"' || entity_type || '\":' || n, ',' ORDER BY '\"' || entity_type || '\":' || n) || '}'), 1, 16) AS fingerprint FROM (SELECT entity_type, COUNT(*) AS n FROM nodes GROUP BY 1)", NODES)
def graph_fingerprint(t):
    return nodes.fingerprint(t.nodes.groupBy(F.col("entity_type").alias("name")).agg(F.count("*").alias("n")))


@query("SELECT COALESCE(k.type_id, s.type_id) AS type_id, k.type_id IS NOT NULL AS defined, COALESCE(n, 0) AS n FROM (VALUES ('domain'), ('system'), ('dataset'), ('report')) k(type_id) FULL JOIN (SELECT entity_type AS type_id, COUNT(*) AS n FROM nodes GROUP BY 1) s ON s.type_id = k.type_id", NODES)
def graph_schema(t):
    known = t.spark.createDataFrame([(x,) for x in ("domain", "system", "dataset", "report")], "type_id string")
    return ontology.schema_merge(known, t.nodes.groupBy(F.col("entity_type").alias("type_id")).agg(F.count("*").alias("n")))


@query("h AS (SELECT DISTINCT a.entity_type AS p, b.entity_type AS c FROM containment x JOIN nodes a ON a.urn = x.parent_urn JOIN nodes b ON b.urn = x.child_urn WHERE a.entity_type <> b.entity_type) SELECT e.type_id, COALESCE((SELECT STRING_AGG(c, ',' ORDER BY c) FROM h WHERE p = e.type_id), '') AS can_contain, e.type_id NOT IN (SELECT c FROM h) AS root FROM (SELECT DISTINCT entity_type AS type_id FROM nodes) e", NODES, ANC)
def ontology_derived(t):
    return ontology.derived_types(t.nodes, t.containment)


@query("SELECT n.entity_type, CASE WHEN n.entity_type = 'column' THEN 'unknown type' WHEN p.entity_type = 'system' AND n.entity_type = 'container' THEN 'parent may not contain it' END AS error, COUNT(*) AS n FROM nodes n LEFT JOIN containment c ON c.child_urn = n.urn LEFT JOIN nodes p ON p.urn = c.parent_urn GROUP BY 1, 2", NODES, ANC)
def node_checks(t):
    """All nodes against an ontology that knows no column and lets systems contain datasets alone."""
    types = t.spark.createDataFrame([(a, b, ["dataset"] if a == "system" else []) for a, b, _ in ontology.ENTITY_TYPES if a != "column"], ontology.ENTITY)
    return ontology.check_nodes(t.nodes, t.containment, types).groupBy("entity_type", "error").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT entity_type AS type_id, entity_type = 'container' AS allowed FROM nodes", NODES)
def children_allowed(t):
    types = t.nodes.select(F.col("entity_type").alias("type_id")).distinct().join(ontology.tables(t.spark)[0], "type_id")
    return ontology.allowed_children(types, "system")


@query("SELECT source_urn, target_urn, weight FROM pairs WHERE source_urn = 'urn:lg:tpch:domain:1' AND LIST_HAS_ANY(STRING_SPLIT(edge_types, ','), ['PRODUCES'])", PAIRS)
def hop_by_type(t):
    return traversal.hop_pairs(t.pairs.where(F.col("source_urn") == DOMAIN), ["PRODUCES"]).select("source_urn", "target_urn", "weight")


@query("self AS (SELECT urn, ancestor_urn, dist FROM anc UNION ALL SELECT urn, urn, 0 FROM nodes), ends AS (SELECT source_urn AS u FROM edges UNION SELECT target_urn FROM edges) SELECT urn, ARG_MIN(ancestor_urn, dist) AS anchor, CAST(MIN(dist) AS INTEGER) AS dist FROM self WHERE ancestor_urn IN (SELECT u FROM ends) GROUP BY 1", NODES, EDGES, ANC)
def inherited_anchors(t):
    return traversal.with_lineage_in(t.edges, t.graph.ups)


@query("s AS (SELECT urn FROM nodes WHERE level = 4 AND urn LIKE 'urn:lg:tpch:column:1-%'), st AS (SELECT urn FROM s WHERE urn IN (SELECT source_urn FROM edges) UNION SELECT parent_urn FROM containment WHERE child_urn IN (SELECT urn FROM s) AND child_urn NOT IN (SELECT source_urn FROM edges)), w AS (SELECT urn, 0 AS depth FROM st UNION SELECT e.target_urn, w.depth + 1 FROM w JOIN edges e ON e.source_urn = w.urn WHERE w.depth < 3) SELECT urn, MIN(depth) AS depth FROM w GROUP BY 1 HAVING MIN(depth) > 0", NODES, EDGES, ANC)
def inherited_lineage(t):
    start = t.nodes.where("level = 4 and urn like 'urn:lg:tpch:column:1-%'").select("urn")
    return traversal.reach(t.edges, traversal.starts_or_parents(t.edges, t.containment, start, "downstream"), "downstream", 3)


@query(f"{_walk('downstream', SUPPLIER, 2)}, f AS (SELECT urn, MIN(depth) AS depth FROM w GROUP BY 1 HAVING MIN(depth) > 0) SELECT urn, depth, (SELECT COUNT(*) FROM f) > 25 AS truncated FROM f ORDER BY depth, urn LIMIT 25", EDGES)
def trace_within_budget(t):
    return traversal.within_budget(traversal.reach(t.edges, t.urns(SUPPLIER), "downstream", 2), 25)


@query(f"{_VIEWS} SELECT COUNT(*) AS total, COUNT(*) FILTER (age_days <= 7) AS recent, COUNT(*) FILTER ({_HEALTH} <> 'healthy') AS attention, MIN(age_days) AS newest FROM full_v")
def view_stats(t):
    return catalog.view_stats(_full(t), views.needs_attention(), 7)


@query("c AS (SELECT 'customer' AS entity_type, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part), f AS (SELECT *, CASE WHEN LOWER(name) = 'customer#000000001' THEN 3 WHEN STARTS_WITH(LOWER(name), 'customer#000000001') THEN 2 WHEN CONTAINS(LOWER(name), 'customer#000000001') THEN 1 END AS score FROM c), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_type ORDER BY score DESC, name, id) AS pos FROM f WHERE score IS NOT NULL) SELECT entity_type, id, score FROM r WHERE pos <= 10 ORDER BY score DESC, name, entity_type, id LIMIT 25")
def entity_search(t):
    one = lambda table, kind, key, name: t.read(table).select(F.lit(kind).alias("entity_type"), F.col(key).alias("id"), F.col(name).alias("name"))
    every = one("customer", "customer", "c_custkey", "c_name").union(one("supplier", "supplier", "s_suppkey", "s_name")).union(one("part", "part", "p_partkey", "p_name"))
    return catalog.entity_search(every, "Customer#000000001", 10, 25)


_SHARED = "vw AS (SELECT doc_id AS view_id, doc_id % 50 AS created_by, CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'workspace' ELSE 'private' END AS visibility, doc_id % 30 AS workspace_id FROM documents), mem AS (SELECT DISTINCT user_id, event_id % 30 AS workspace_id FROM events), gra AS (SELECT DISTINCT event_id % 997 AS view_id, user_id FROM events WHERE event_type = 'purchase')"


def _shared(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    d, e = t.read("documents"), t.read("events")
    own = d.select(F.col("doc_id").alias("view_id"), (F.col("doc_id") % 50).alias("created_by"), F.when(F.col("doc_id") % 3 == 0, "public").when(F.col("doc_id") % 3 == 1, "workspace").otherwise("private").alias("visibility"), (F.col("doc_id") % 30).alias("workspace_id"))
    return own, e.select("user_id", (F.col("event_id") % 30).alias("workspace_id")), e.where("event_type = 'purchase'").select((F.col("event_id") % 997).alias("view_id"), "user_id")


@query(f"{_SHARED}, x AS (SELECT view_id, CASE WHEN created_by = 7 THEN 'own' WHEN visibility = 'public' THEN 'public' WHEN visibility = 'workspace' AND workspace_id IN (SELECT workspace_id FROM mem WHERE user_id = 7) THEN 'member' WHEN view_id IN (SELECT view_id FROM gra WHERE user_id = 7) THEN 'grant' END AS via FROM vw) SELECT * FROM x WHERE via IS NOT NULL")
def readable_views(t):
    return access.readable(*_shared(t), 7)


@query(f"{_SHARED} SELECT view_id, created_by = 7 OR workspace_id = 3 OR view_id IN (SELECT view_id FROM gra WHERE user_id = 7) AS may_edit, created_by = 7 OR workspace_id = 3 AS may_delete FROM vw")
def view_actions(t):
    own, _, grants = _shared(t)
    given = grants.where("user_id = 7").select("view_id", F.lit(True).alias("g")).distinct()
    mine, permitted, editor = F.col("created_by") == 7, F.col("workspace_id") == 3, F.coalesce("g", F.lit(False))
    return own.join(given, "view_id", "left").select("view_id", *[access.may(a, mine, permitted, editor).alias(f"may_{a}") for a in ("edit", "delete")])


@query(f"{_GRANTS}, b AS (SELECT DISTINCT user_id, user_id % 3 AS scope_id, event_type AS role FROM events) SELECT DISTINCT user_id, scope_id, CASE WHEN role = 'purchase' THEN 'graph:*' WHEN role = 'click' THEN 'graph:write' ELSE 'graph:read' END AS permission FROM b WHERE role IN ('view', 'click', 'purchase') AND (role = 'purchase' OR NOT EXISTS (SELECT 1 FROM b x WHERE x.user_id = b.user_id AND x.role = 'purchase'))")
def wildcard_permissions(t):
    bindings = t.read("events").select(F.lit("user").alias("subject_type"), F.col("user_id").alias("subject_id"), F.col("event_type").alias("role"), (F.col("user_id") % 3).alias("scope_id"))
    granted = t.spark.createDataFrame([("view", "graph:read"), ("click", "graph:write"), ("purchase", "graph:*")], "role string, permission string")
    return catalog.permissions(bindings, t.spark.createDataFrame([], "group_id long, user_id long"), granted)


@query(f"{_STATUS}, n AS (SELECT status, COUNT(*) AS n FROM j GROUP BY 1) SELECT status, n, (SELECT ROUND(100.0 * SUM(n) FILTER (status = 'completed') / SUM(n) FILTER (status IN ('completed', 'failed')), 1) FROM n)::DOUBLE AS success FROM n")
def job_summary(t):
    return catalog.job_summary(_orders(t))


@query(f"{_JOBS}, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY sequence DESC) AS r FROM je), l AS (SELECT * FROM k WHERE r <= 20) SELECT job_id, sequence, MIN(sequence) OVER (PARTITION BY job_id) > 5 AS truncated FROM l QUALIFY sequence >= 5")
def event_backfill(t):
    return ev.backfill(ev.retained(t.jobs, 20), 5)


@query(f"{_JOBS}, p AS (SELECT job_id, MIN(sequence) AS oldest FROM je WHERE type = 'purchase' GROUP BY 1) SELECT je.job_id, je.sequence FROM je LEFT JOIN p ON p.job_id = je.job_id WHERE ts >= TIMESTAMP '2024-01-15' OR COALESCE(sequence >= oldest, FALSE)")
def event_trim(t):
    return ev.trimmed(t.jobs, t.jobs.where("type = 'purchase'"), "2024-01-15").select("job_id", "sequence")


@query("SELECT o_orderkey AS job_id, CAST(LEAST(5 * POWER(2, o_orderkey % 8), 120) AS BIGINT) AS wait FROM orders")
def retry_waits(t):
    return t.read("orders").select(F.col("o_orderkey").alias("job_id"), jobs.retry_seconds(F.col("o_orderkey") % 8).alias("wait"))


@query(f"{_JOBS} SELECT job_id, CAST(FLOOR(EPOCH(TIMESTAMP '2030-01-01')) - FLOOR(EPOCH(MAX(ts))) AS BIGINT) AS age FROM je GROUP BY 1")
def stuck_jobs(t):
    return ev.stuck(t.jobs, "2030-01-01", 3600)


@query("SELECT doc_id, CASE WHEN n_chars >= 604800 THEN 'expired' WHEN n_chars <= 300 THEN 'fresh' ELSE 'stale' END AS freshness, CASE WHEN n_chars <= 60 THEN 'healthy' WHEN n_chars <= 600 THEN 'lagging' ELSE 'unreachable' END AS health FROM documents")
def freshness(t):
    return t.read("documents").select("doc_id", scalar.freshness(F.col("n_chars")).alias("freshness"), scalar.service_health(F.col("n_chars")).alias("health"))


@query("SELECT e.id FROM edges e WHERE source_urn IN (SELECT urn FROM nodes WHERE level < 4) AND target_urn IN (SELECT urn FROM nodes WHERE level < 4)", NODES, EDGES)
def edges_not_dangling(t):
    return graph.drop_dangling(t.edges, t.nodes.where("level < 4")).select("id")


@query("SELECT parent_urn, child_urn FROM containment", ANC)
def containment_normalised(t):
    """Containment of which every second edge is written the other way round, as BELONGS_TO."""
    c = t.containment.withColumn("up", F.pmod(F.xxhash64("child_urn"), F.lit(2)) == 0)
    e = c.select(F.col("child_urn").alias("id"), F.when(F.col("up"), F.col("child_urn")).otherwise(F.col("parent_urn")).alias("source_urn"), F.when(F.col("up"), F.col("parent_urn")).otherwise(F.col("child_urn")).alias("target_urn"), F.when(F.col("up"), "belongs_to").otherwise("CONTAINS").alias("edge_type"))
    return graph.normalise_containment(e, ["contains", "BELONGS_TO"]).select("parent_urn", "child_urn")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -1 - o_orderkey, 1.0 FROM orders WHERE o_orderstatus = 'P'")
def orders_upserted(t):
    o = t.read("orders")
    old = o.select("o_orderkey", "o_totalprice")
    closed = o.where("o_orderstatus = 'F'").select("o_orderkey")
    new = closed.select("o_orderkey", F.lit(9.0).alias("o_totalprice"), F.lit(1).alias("version")).union(closed.select("o_orderkey", F.lit(0.0), F.lit(2))).union(o.where("o_orderstatus = 'P'").select(-1 - F.col("o_orderkey"), F.lit(1.0), F.lit(1)))
    return graph.upsert(old, new, ["o_orderkey"])


@query("SELECT entity_type, CASE entity_type WHEN 'container' THEN 'acctbal' WHEN 'column' THEN 'discount,quantity' WHEN 'dataset' THEN 'retailprice,size,totalprice' ELSE '' END AS property_keys, COUNT(*) AS n FROM nodes GROUP BY 1", NODES)
def discovered_schema(t):
    return graph.discover_schema(t.nodes).select("entity_type", "property_keys", "n")


@query("SELECT urn FROM nodes WHERE level <= 2 AND urn IN (SELECT a.urn FROM anc a WHERE a.ancestor_urn = 'urn:lg:tpch:system:1') AND LOWER(display_name) LIKE '%1%' ORDER BY display_name DESC, urn LIMIT 10", NODES, ANC)
def children_searched(t):
    own = hierarchy.children(t.nodes, t.containment, NATION)
    return own.where(nodes.name_filter("contains", "1")).orderBy(F.desc("display_name"), "urn").limit(10).select("urn")
