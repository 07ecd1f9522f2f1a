"""Queries over foreign graphs, stateful folds and documents with versions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import ontology, versions
from tracewell.plans.catalogue import _JOBS, Tables, query
from tracewell.plans.governance import _values
from tracewell.sources import foreign
from tracewell.streaming import state

_CLAIMS = "rq AS (SELECT event_type AS scope, event_id AS request_id, CAST(FLOOR(EPOCH(ts)) AS BIGINT) AS s, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY FLOOR(EPOCH(ts)), event_id) AS r FROM events)"


@query(
    f"{_CLAIMS}, nm AS (SELECT scope, r, 1 + COUNT(*) OVER (PARTITION BY scope ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND 7199 FOLLOWING) AS nr FROM rq), "
    "gr AS (SELECT scope, CAST(1 AS BIGINT) AS r FROM rq WHERE r = 1 UNION ALL SELECT nm.scope, nm.nr FROM gr JOIN nm ON nm.scope = gr.scope AND nm.r = gr.r) "
    "SELECT rq.scope, request_id, gr.r IS NOT NULL AS granted FROM rq LEFT JOIN gr ON gr.scope = rq.scope AND gr.r = rq.r"
)
def claims_granted(t):
    """Every event asks for its type; a claim holds for two hours."""
    asks = t.read("events").select(F.col("event_type").alias("scope"), F.col("event_id").alias("request_id"), F.unix_timestamp("ts").alias("s"))
    return state.claimed(asks, ["scope"], "s", "request_id", 7200).select("scope", "request_id", "granted")


@query(
    f"{_JOBS}, g AS (SELECT *, CASE WHEN EPOCH_MS(ts) - EPOCH_MS(LAG(ts) OVER (PARTITION BY job_id ORDER BY ts, sequence)) > 43200000 THEN 1 ELSE 0 END AS gap FROM je), p AS (SELECT *, SUM(gap) OVER (PARTITION BY job_id ORDER BY ts, sequence) AS part FROM g), "
    "q AS (SELECT *, MAX(part) OVER (PARTITION BY job_id) AS newest, COALESCE(MAX(sequence) FILTER (type = 'purchase') OVER (PARTITION BY job_id), 0) AS ended, MAX(sequence) OVER (PARTITION BY job_id) AS last FROM p), "
    "f AS (SELECT job_id, last, type, ARG_MAX(event_id, sequence) AS v FROM q WHERE part = newest AND type <> 'purchase' AND sequence > ended GROUP BY 1, 2, 3) SELECT job_id, last AS sequence, STRING_AGG(type || '=' || v, ',' ORDER BY type) AS fields FROM f GROUP BY 1, 2"
)
def live_fields(t):
    """Each type of event is a field with the event's number; a purchase ends a job, and so do twelve quiet hours."""
    own = t.jobs.withColumn("fields", F.create_map("type", F.col("event_id").cast("string")))
    live = state.live_fields(own, "purchase", 43_200)
    return live.select("job_id", "sequence", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fields"))


MAPPING = {"urn": "uuid", "display_name": "name", "tags": "labels", "properties": "props"}


def _foreign(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customers and orders as a foreign graph: ids, labels and JSON of properties."""
    text = lambda c: F.col(c).cast("string")
    key = lambda kind, c: F.concat(F.lit(f"{kind}-"), text(c))
    some = F.when(F.col("c_custkey") % 3 == 0, F.to_json(F.array("c_mktsegment"))).when(F.col("c_custkey") % 3 == 1, F.lit("not json"))
    props = F.to_json(F.struct(key("cust", "c_custkey").alias("uuid"), F.col("c_name").alias("name"), some.alias("labels"), F.to_json(F.struct(text("c_nationkey").alias("nation"), F.lit("inner").alias("both"))).alias("props"), text("c_custkey").alias("key"), F.lit("outer").alias("both")))
    customers = t.read("customer").select(key("c", "c_custkey").alias("id"), F.array(F.lit("container"), F.lit("Customer")).alias("labels"), props.alias("properties"))
    order = F.to_json(F.struct(key("ord", "o_orderkey").alias("uuid"), F.col("o_orderstatus").alias("status"), F.lit("report").alias("kind")))
    orders = t.read("orders").select(key("o", "o_orderkey"), F.array().cast("array<string>"), order)
    placed = t.read("orders").select(F.lit("x").alias("id"), F.lit("PLACED").alias("label"), key("c", "o_custkey").alias("start_id"), key("o", "o_orderkey").alias("end_id"), F.to_json(F.struct((F.col("o_orderkey") % 10 / 10).alias("confidence"))).alias("properties"))
    return customers.union(orders), placed


@query(
    f"d(type_id, level) AS (VALUES {_values(ontology.ENTITY_TYPES)}) SELECT 'cust-' || c_custkey AS urn, 'container' AS entity_type, 2 AS level, c_name AS display_name, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment ELSE '' END AS tags, 'both=inner,key=' || c_custkey || ',nation=' || c_nationkey AS properties FROM customer "
    "UNION ALL SELECT 'ord-' || o_orderkey, 'unknown', NULL, '', '', 'kind=report,status=' || o_orderstatus FROM orders"
)
def foreign_nodes(t):
    levels = ontology.tables(t.spark)[0]
    nodes = foreign.map_nodes(_foreign(t)[0], MAPPING, levels)
    pairs = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return nodes.select("urn", "entity_type", "level", "display_name", F.array_join("tags", ",").alias("tags"), F.array_join(pairs, ",").alias("properties"))


@query("SELECT 'cust-' || o_custkey || '|PLACED|' || 'ord-' || o_orderkey AS id, 'cust-' || o_custkey AS source_urn, 'ord-' || o_orderkey AS target_urn, (o_orderkey % 10 / 10)::DOUBLE AS confidence FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def foreign_edges(t):
    nodes, placed = _foreign(t)
    mapped = foreign.map_nodes(nodes, MAPPING, ontology.tables(t.spark)[0])
    return foreign.map_edges(placed, mapped, {}).select("id", "source_urn", "target_urn", "confidence")


@query("SELECT label, field, key FROM (SELECT UNNEST(['container', 'Customer', NULL]) AS label) CROSS JOIN (VALUES ('urn', 'uuid'), ('display_name', 'name'), ('tags', 'labels')) v(field, key) WHERE EXISTS (SELECT 1 FROM customer)")
def mapping_suggested(t):
    return foreign.suggested(foreign.property_keys(_foreign(t)[0].where(F.size("labels") > 0)))


def _documents(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Each nation's suppliers and customers as a document, before and after some of them changed."""
    own = t.read("supplier").select(F.col("s_nationkey").alias("id"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 4).alias("m"))
    entry = lambda *cols: F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("k").cast("string")), F.struct(*cols)))))
    before = own.groupBy("id").agg(F.to_json(entry("name", "m")).alias("value"))
    # Other order of keys; a quarter renamed; a quarter gone.
    after = own.where("m <> 3").withColumn("name", F.when(F.col("m") == 2, F.lower("name")).otherwise(F.col("name"))).groupBy("id").agg(F.to_json(entry("m", "name")).alias("value"))
    return before, after


_DIFF = "sp AS (SELECT s_nationkey AS id, s_suppkey, s_suppkey % 4 AS m, s_name FROM supplier), ids AS (SELECT DISTINCT id FROM sp WHERE m <> 3)"


@query(f"{_DIFF} SELECT id, BOOL_OR(m >= 2) AS changed, CASE WHEN BOOL_OR(m >= 2) THEN 'entities' ELSE '' END AS fields, '' AS added, COALESCE(STRING_AGG('entities.s' || s_suppkey, ',' ORDER BY 'entities.s' || s_suppkey) FILTER (m = 3), '') AS removed FROM sp GROUP BY 1")
def ontology_import_diff(t):
    field = lambda df: df.select("id", F.lit("entities").alias("field"), "value")
    before, after = _documents(t)
    same = before.select("id", F.lit("name").alias("field"), F.to_json(F.array(F.col("id"))).alias("value"))
    return versions.import_diff(field(before).union(same), field(after).union(same), ["entities"])


@query(
    f"{_DIFF} SELECT id, 's' || s_suppkey || '.name' AS path, CASE m WHEN 2 THEN 'changed' ELSE 'removed' END AS change, '\"' || s_name || '\"' AS old, CASE m WHEN 2 THEN '\"' || LOWER(s_name) || '\"' END AS new FROM sp WHERE m >= 2 AND id IN (SELECT id FROM ids) "
    "UNION ALL SELECT id, 's' || s_suppkey || '.m', 'removed', '3', NULL FROM sp WHERE m = 3 AND id IN (SELECT id FROM ids)"
)
def document_changes(t):
    return versions.differ(*_documents(t))


@query(
    f"{_JOBS}, e AS (SELECT job_id AS id, sequence AS seq, CASE type WHEN 'view' THEN 'import' WHEN 'click' THEN 'publish' WHEN 'purchase' THEN 'new_version' WHEN 'signup' THEN 'delete' ELSE 'restore' END AS action, CASE WHEN type = 'view' THEN event_id % 2 END AS text FROM je), "
    "a AS (SELECT *, LAST_VALUE(text IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM e), "
    "b AS (SELECT *, so_far IS NOT NULL AS known, action = 'import' AND text IS DISTINCT FROM so_far AS fresh FROM a), "
    "c AS (SELECT *, CASE WHEN fresh OR (action = 'new_version' AND known) THEN 'draft' WHEN action = 'publish' AND known THEN 'published' END AS sets FROM b), "
    "d AS (SELECT *, LAST_VALUE(sets IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM c), "
    "f AS (SELECT *, fresh AND (NOT known OR COALESCE(was = 'published', FALSE)) OR (action = 'new_version' AND known) AS counts FROM d) "
    "SELECT id, seq, action, CASE WHEN action = 'import' AND NOT fresh THEN 'no_changes' WHEN fresh AND NOT known THEN 'created' WHEN fresh AND counts THEN 'new_draft' WHEN fresh THEN 'updated' WHEN NOT known THEN 'none' WHEN action = 'publish' THEN CASE WHEN was = 'published' THEN 'none' ELSE 'published' END WHEN action = 'delete' THEN 'deleted' WHEN action = 'restore' THEN 'restored' ELSE action END AS outcome, "
    "CAST(SUM(CASE WHEN counts THEN 1 ELSE 0 END) OVER w AS INTEGER) AS version, LAST_VALUE(sets IGNORE NULLS) OVER w AS status, COALESCE(LAST_VALUE(CASE WHEN NOT known THEN NULL WHEN action = 'delete' THEN TRUE WHEN action = 'restore' THEN FALSE END IGNORE NULLS) OVER w, FALSE) AS deleted FROM f WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)
def document_lifecycle(t):
    kind = F.col("type")
    action = F.when(kind == "view", "import").when(kind == "click", "publish").when(kind == "purchase", "new_version").when(kind == "signup", "delete").otherwise("restore")
    even = F.col("event_id") % 4 < 2
    content = F.when(even, F.concat(F.lit('{"b": 1, "a": '), (F.col("event_id") % 2).cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"a":'), (F.col("event_id") % 2).cast("string"), F.lit(',"b":1}')))
    return versions.lifecycle(t.jobs.select(F.col("job_id").alias("id"), F.col("sequence").alias("seq"), action.alias("action"), content.alias("content")))
