"""Queries over views, access, jobs and graph views, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import access, canvas, rollup, traversal, views
from tracewell.plans.catalogue import _FAVOURITES, _GRANTS, _JOBS, DOMAIN, NATION, PART, PLATFORM, SUPPLIER, Tables, _permissions, _walk, query
from tracewell.plans.sql import ANC, EDGES, NODES, PAIRS
from tracewell.streaming import jobs

#: Views are documents, workspaces nations (some are missing), data sources suppliers.
_VIEWS = "v AS (SELECT doc_id AS view_id, lang AS view_type, source AS created_by, doc_id % 30 AS workspace_id, 1 + doc_id % 12 AS data_source_id, n_chars % 120 AS age_days FROM documents), w AS (SELECT n_nationkey AS workspace_id, n_name AS workspace_name, n_regionkey <> 3 AS workspace_active, n_regionkey AS region FROM nation), s AS (SELECT s_suppkey AS data_source_id, s_name AS source_name, s_acctbal >= 0 AS source_active FROM supplier), full_v AS (SELECT * FROM v LEFT JOIN w USING (workspace_id) LEFT JOIN s USING (data_source_id))"
_HEALTH = "CASE WHEN workspace_active IS NULL THEN 'broken' WHEN NOT workspace_active THEN 'warning' WHEN source_active IS NULL THEN 'broken' WHEN NOT source_active THEN 'warning' WHEN age_days > 90 THEN 'stale' ELSE 'healthy' END"


def _views(t: Tables) -> DataFrame:
    return t.read("documents").select(F.col("doc_id").alias("view_id"), F.col("lang").alias("view_type"), F.col("source").alias("created_by"), (F.col("doc_id") % 30).alias("workspace_id"), (1 + F.col("doc_id") % 12).alias("data_source_id"), (F.col("n_chars") % 120).alias("age_days"))


def _workspaces(t: Tables) -> DataFrame:
    return t.read("nation").select(F.col("n_nationkey").alias("workspace_id"), F.col("n_name").alias("workspace_name"), (F.col("n_regionkey") != 3).alias("workspace_active"), F.col("n_regionkey").alias("region"))


def _full(t: Tables) -> DataFrame:
    sources = t.read("supplier").select(F.col("s_suppkey").alias("data_source_id"), F.col("s_name").alias("source_name"), (F.col("s_acctbal") >= 0).alias("source_active"))
    return views.with_sources(_views(t), _workspaces(t), sources)


def _favourites(t: Tables) -> DataFrame:
    n = t.views.count()
    return t.read("events").where("event_type = 'view'").select((F.col("event_id") % n).alias("view_id"), "user_id")


@query(f"{_VIEWS} SELECT view_id, {_HEALTH} AS health FROM full_v")
def view_health(t):
    return _full(t).select("view_id", views.health().alias("health"))


@query(f"{_VIEWS} SELECT view_id FROM full_v WHERE {_HEALTH} <> 'healthy' AND view_type IN ('en', 'de') AND (LOWER(created_by) LIKE '%e%' OR LOWER(workspace_name) LIKE '%e%' OR LOWER(source_name) LIKE '%e%')")
def views_filtered(t):
    return _full(t).where(views.needs_attention() & F.col("view_type").isin("en", "de") & views.any_contains(["created_by", "workspace_name", "source_name"], "E")).select("view_id")


#: Whole views: dates, deletion, tags and visibility come from the documents' numbers.
_WHOLE = (
    f"{_FAVOURITES}, {_VIEWS}, wv AS (SELECT f.*, 'view ' || view_id AS name, CASE WHEN view_id % 5 = 0 THEN NULL ELSE 'about ' || view_type END AS description, CASE view_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'workspace' ELSE 'private' END AS visibility, "
    "CASE WHEN view_id % 7 = 0 THEN DATE '2024-02-01' END AS deleted_at, DATE '2024-01-01' + CAST(view_id % 60 AS INTEGER) AS created_at, '[\"' || CASE view_id % 4 WHEN 0 THEN 'pii' WHEN 1 THEN 'Finance' ELSE 'pi' END || '\"]' AS tags, view_id % 9 AS context_model_id, COALESCE(view_id IN (SELECT view_id FROM fav WHERE user_id = 1), FALSE) AS is_favourited FROM full_v f)"
)


def _whole_views(t: Tables) -> DataFrame:
    n = F.col("view_id")
    mine = _favourites(t).where("user_id = 1").select("view_id", F.lit(True).alias("is_favourited")).distinct()
    named = {
        "name": F.concat(F.lit("view "), n.cast("string")), "description": F.when(n % 5 != 0, F.concat(F.lit("about "), "view_type")), "visibility": F.when(n % 3 == 0, "public").when(n % 3 == 1, "workspace").otherwise("private"), "deleted_at": F.when(n % 7 == 0, F.lit("2024-02-01").cast("date")),
        "created_at": F.date_add(F.lit("2024-01-01").cast("date"), (n % 60).cast("int")), "tags": F.concat(F.lit('["'), F.when(n % 4 == 0, "pii").when(n % 4 == 1, "Finance").otherwise("pi"), F.lit('"]')), "context_model_id": n % 9, "is_favourited": F.coalesce("is_favourited", F.lit(False)),
    }
    return _full(t).join(mine, "view_id", "left").withColumns(named)


#: Ways to ask for views, with the SQL condition of each.
ASKED = {
    "plain": ({}, "deleted_at IS NULL"),
    "deleted": ({"deleted": "only", "view_type": "en"}, "deleted_at IS NOT NULL AND view_type = 'en'"),
    "several": ({"deleted": "too", "view_types": ["de", "fr"], "view_type": "en", "visibility_in": ["public", "private"], "visibility": "workspace", "context_model_id": 4}, "view_type IN ('de', 'fr') AND visibility IN ('public', 'private') AND context_model_id = 4"),
    "dated": ({"created_after": "2024-02-10", "workspace_ids": [1, 2, 3, 27], "data_source_id": 3}, "deleted_at IS NULL AND created_at >= DATE '2024-02-10' AND workspace_id IN (1, 2, 3, 27) AND data_source_id = 3"),
    "tagged": ({"tags": ["PII", "finance"], "favourited_only": True}, "deleted_at IS NULL AND (tags ILIKE '%\"pii\"%' OR tags ILIKE '%\"finance\"%') AND is_favourited"),
    "searched": ({"search": "An", "attention_only": True}, f"deleted_at IS NULL AND CONCAT_WS(CHR(10), LOWER(name), LOWER(description), LOWER(workspace_name), LOWER(source_name), LOWER(created_by), LOWER(tags)) LIKE '%an%' AND {_HEALTH} <> 'healthy'"),
}


@query(f"{_WHOLE} " + " UNION ALL ".join(f"SELECT '{k}' AS asked, view_id FROM wv WHERE {sql}" for k, (_, sql) in ASKED.items()))
def view_filters(t):
    """Every option of the filter, in six requests."""
    every = _whole_views(t)
    marks = F.array_compact(F.array(*[F.when(views.view_filter(**k), name) for name, (k, _) in ASKED.items()]))
    return every.select(F.explode(marks).alias("asked"), "view_id")


@query(f"{_WHOLE}, l AS (SELECT view_id, ROW_NUMBER() OVER (ORDER BY age_days, view_id) AS pos, COUNT(*) OVER () AS total FROM wv WHERE deleted_at IS NULL AND visibility = 'public') SELECT view_id, pos, total, total > 40 AS has_more, CASE WHEN total > 40 THEN 40 END AS next_offset FROM l WHERE pos > 20 AND pos <= 40")
def views_listed(t):
    """The second page of twenty public views, the latest first."""
    return views.listed(_whole_views(t), views.view_filter(visibility="public"), ["age_days", "view_id"], 20, 20).select("view_id", "pos", "total", "has_more", "next_offset")


@query(f"{_FAVOURITES}, {_VIEWS}, n AS (SELECT view_id, COUNT(*) AS n, BOOL_OR(user_id = 1) AS mine FROM fav GROUP BY 1) SELECT f.view_id, workspace_name, source_name, COALESCE(n, 0) AS favourite_count, COALESCE(mine, FALSE) AS is_favourited FROM full_v f LEFT JOIN n ON n.view_id = f.view_id")
def views_enriched(t):
    return views.enriched(_full(t), _favourites(t), 1).select("view_id", "workspace_name", "source_name", "favourite_count", "is_favourited")


@query(f"{_VIEWS} SELECT workspace_id, data_source_id, COUNT(*) AS n FROM v GROUP BY GROUPING SETS ((workspace_id), (data_source_id), ())")
def view_counts(t):
    return views.counts(_views(t))


@query(f"{_VIEWS} SELECT region, COUNT(DISTINCT w.workspace_id) AS workspaces, COUNT(DISTINCT view_id) AS views FROM w LEFT JOIN v ON v.workspace_id = w.workspace_id GROUP BY 1")
def provider_impact(t):
    return views.impact(_views(t), _workspaces(t), "region")


def _bindings(t: Tables) -> DataFrame:
    e = t.read("events")
    group = F.col("event_id") % 2 == 1
    return e.select(F.when(group, "group").otherwise("user").alias("subject_type"), F.when(group, F.col("user_id") % 7).otherwise(F.col("user_id")).alias("subject_id"), F.col("event_type").alias("role"), (F.col("event_id") % 3).alias("scope_id")).distinct()


def _members(t: Tables) -> DataFrame:
    return t.read("events").select((F.col("user_id") % 5).alias("group_id"), "user_id").distinct()


_BINDINGS = "b AS (SELECT DISTINCT CASE event_id % 2 WHEN 1 THEN 'group' ELSE 'user' END AS subject_type, CASE event_id % 2 WHEN 1 THEN user_id % 7 ELSE user_id END AS subject_id, event_type AS role, event_id % 3 AS scope_id FROM events), m AS (SELECT DISTINCT user_id % 5 AS group_id, user_id FROM events), x AS (SELECT subject_id AS user_id, role, scope_id, 'direct' AS via, CAST(NULL AS BIGINT) AS group_id FROM b WHERE subject_type = 'user' UNION ALL SELECT m.user_id, role, scope_id, 'group', m.group_id FROM b JOIN m ON m.group_id = subject_id WHERE subject_type = 'group')"


@query(f"{_BINDINGS} SELECT role, COUNT(*) AS n FROM b GROUP BY 1")
def bindings_per_role(t):
    return access.bindings_per_role(_bindings(t))


@query(f"{_BINDINGS} SELECT user_id, role, scope_id, via, COUNT(DISTINCT group_id) AS groups FROM x GROUP BY 1, 2, 3, 4")
def access_explained(t):
    return access.explained(_bindings(t), _members(t))


@query(f"{_BINDINGS} SELECT DISTINCT user_id FROM x WHERE role = 'purchase'")
def users_of_role(t):
    return access.users_of_role(_bindings(t), _members(t), "purchase")


@query(f"{_GRANTS}, after AS (SELECT DISTINCT e.user_id, e.user_id % 3 AS scope_id, permission FROM events e JOIN gr ON gr.role = e.event_type WHERE e.event_type <> 'click') SELECT user_id, 'lost' AS change, STRING_AGG(DISTINCT permission, ',' ORDER BY permission) AS permissions, COUNT(DISTINCT scope_id) AS scopes FROM (SELECT * FROM perms ANTI JOIN after USING (user_id, scope_id, permission)) GROUP BY 1")
def permission_preview(t):
    return access.preview(_permissions(t), _permissions(t, "click"))


@query("SELECT p_brand, COUNT(DISTINCT p_size) AS versions FROM part GROUP BY 1 HAVING COUNT(DISTINCT p_size) > 1")
def schemas_at_many_versions(t):
    return access.multi_version(t.read("part"), "p_brand", "p_size")


@query("SELECT n.urn FROM nodes n WHERE n.urn NOT IN (SELECT a.urn FROM anc a JOIN nodes c ON c.urn = a.ancestor_urn AND c.entity_type IN ('dataPlatform', 'system'))", NODES, ANC)
def collapsed_view(t):
    return canvas.uncollapsed(t.nodes, t.closure, t.nodes.where("entity_type in ('dataPlatform', 'system')")).select("urn")


@query(f"{_walk('downstream', SUPPLIER, 2)} SELECT urn FROM w UNION SELECT a.ancestor_urn FROM anc a JOIN w ON w.urn = a.urn", EDGES, ANC)
def trace_context(t):
    start = t.urns(SUPPLIER)
    return canvas.traced_with_ancestors(traversal.reach(t.edges, start, "downstream", 2).select("urn").union(start), t.closure)


@query(f"{_walk('downstream', PART, 2)}, u AS (SELECT source_urn AS urn FROM edges WHERE target_urn = '{PART}'), l AS (SELECT urn, BOOL_OR(up) AS up, BOOL_OR(NOT up) AS down FROM (SELECT urn, TRUE AS up FROM u UNION ALL SELECT urn, FALSE FROM w WHERE depth > 0) GROUP BY 1) SELECT COUNT(*) FILTER (up) AS upstream, COUNT(*) FILTER (down) AS downstream, COUNT(*) AS total FROM l", EDGES)
def trace_statistics(t):
    return canvas.trace_statistics(traversal.full_lineage(t.edges, t.urns(PART), 2))


@query(f"h AS (SELECT urn FROM anc WHERE ancestor_urn = '{NATION}' UNION SELECT '{NATION}') SELECT id FROM edges WHERE source_urn IN (SELECT urn FROM h) OR target_urn IN (SELECT urn FROM h)", EDGES, ANC)
def highlight(t):
    return canvas.highlighted(t.edges, t.closure, NATION)


@query(f"SELECT source_urn, target_urn, 'pair' AS kind FROM pairs WHERE source_urn = '{PLATFORM}' AND target_urn <> '{DOMAIN}' UNION ALL SELECT source_urn, target_urn, 'edge' FROM edges WHERE id IN (SELECT id FROM contrib WHERE source_urn = '{PLATFORM}' AND target_urn = '{DOMAIN}')", PAIRS)
def pair_expanded(t):
    own = rollup.between(t.pairs, [PLATFORM])
    return canvas.pair_expanded(own, rollup.contributions(t.edges, t.closure), t.edges, PLATFORM, DOMAIN)


@query("SELECT p_partkey FROM part WHERE p_size <= 30 AND p_size + 2 >= 10 AND p_retailprice <= 1500 AND p_retailprice + 50 >= 1000")
def viewport(t):
    return t.read("part").where(canvas.in_viewport(F.col("p_size"), F.col("p_retailprice"), 2, 50, (10, 1000, 30, 1500))).select("p_partkey")


@query("SELECT urn, CASE WHEN entity_type = 'dataset' AND REGEXP_MATCHES(urn, ':o[0-9]*1$') THEN 'orders' WHEN entity_type = 'column' AND LIST_CONTAINS(tags, 'R') THEN 'returned' END AS layer FROM nodes", NODES)
def rule_layers(t):
    kind = F.col("entity_type")
    return t.nodes.select("urn", canvas.first_rule([(1, "returned", (kind == "column") & F.array_contains("tags", "R")), (5, "orders", (kind == "dataset") & F.col("urn").rlike(":o[0-9]*1$"))]).alias("layer"))


@query(f"{_JOBS}, p AS (SELECT job_id, MAX(sequence) AS processed, CAST(FLOOR(EPOCH(MAX(ts))) - FLOOR(EPOCH(MIN(ts))) AS BIGINT) AS elapsed FROM je GROUP BY 1) SELECT job_id, processed, ROUND(LEAST(100.0, 100.0::DOUBLE * processed / 40), 1)::DOUBLE AS coverage, CAST(FLOOR((elapsed * GREATEST(0, 40 - processed))::DOUBLE / processed) AS BIGINT) AS eta_seconds FROM p")
def job_progress(t):
    return jobs.progress(t.jobs, 40)


_STATUS = "j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'completed' END AS status, o_orderkey % 5 AS retries, o_orderkey % 3 = 0 AS has_cursor FROM orders)"


def _orders(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.read("orders").select(F.col("o_orderkey").alias("job_id"), F.when(s == "F", "failed").when(s == "O", "running").otherwise("completed").alias("status"), (F.col("o_orderkey") % 5).alias("retries"), (F.col("o_orderkey") % 3 == 0).alias("has_cursor"))


@query(f"{_STATUS} SELECT job_id, status IN ('pending', 'running') AS may_cancel, status IN ('failed', 'cancelled') AND retries < 3 AS may_resume, status NOT IN ('pending', 'running') AS may_purge FROM j")
def job_transitions(t):
    return _orders(t).select("job_id", *[jobs.may(a, F.col("status"), F.col("retries")).alias(f"may_{a}") for a in ("cancel", "resume", "purge")])


@query(f"{_STATUS} SELECT job_id, CASE WHEN status <> 'running' THEN 'none' WHEN has_cursor THEN 'resume' WHEN retries >= 3 THEN 'failed' ELSE 'retry' END AS recovery FROM j")
def job_recovery(t):
    return _orders(t).select("job_id", jobs.recovery(F.col("status"), F.col("has_cursor"), F.col("retries")).alias("recovery"))


@query("SELECT doc_id, CASE WHEN lang IS NULL THEN 'miss' WHEN n_chars >= 2000 THEN 'expired' WHEN COALESCE(source, '') = '' THEN 'empty' WHEN n_chars > 300 THEN 'stale' ELSE 'hit' END AS reason FROM documents")
def cached_reads(t):
    age = F.when(F.col("lang").isNotNull(), F.col("n_chars"))
    return t.read("documents").select("doc_id", jobs.cached_read(age, 2000, 300, F.col("source")).alias("reason"))


@query("SELECT c_custkey AS id FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE COALESCE(s_nationkey <> 3, TRUE) AND c_nationkey * 60 >= GREATEST(COALESCE(s_nationkey * 60, 600), 300)")
def due_polls(t):
    config = t.read("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") != 3).alias("enabled"), (F.col("s_nationkey") * 60).alias("every"))
    return jobs.due(t.read("customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 60).alias("age")), config, 300, 600).select("id")


@query("SELECT event_type AS type, COUNT(*) AS n, MIN(ts) AS oldest FROM events GROUP BY 1")
def queue_depth(t):
    return jobs.queue_depth(t.jobs)


@query(f"{_JOBS} SELECT job_id, type, COUNT(*) AS n, COUNT(*) >= 3 AS dead FROM je GROUP BY 1, 2")
def dead_letters(t):
    return jobs.dead_letters(t.jobs)


@query(f"{_JOBS} SELECT DATE_TRUNC('day', ts) AS start_ts, type, COUNT(*) FILTER (value <= 20) AS ok, COUNT(*) FILTER (value > 20) AS failed, ARG_MAX(value, {{'t': ts, 'e': event_id}}) AS last FROM je GROUP BY 1, 2")
def health_counters(t):
    return jobs.health_counters(t.jobs, F.col("value") > 20, "1 day")


@query()
def circuit_breaker(t):
    return jobs.circuit_breaker(t.jobs, F.col("type") == "click", reset_ms=3_600_000)
