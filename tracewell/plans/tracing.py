"""Queries over whole traces, inferred column lineage, moved subtrees, the forest and scopes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import columns, forest, hierarchy, ontology, rollup, scope, trace, traversal, upkeep
from tracewell.plans.catalogue import DOMAIN, ORDER, PART, Tables, _walk, query
from tracewell.plans.sql import ANC, EDGES, NODES, PAIRS
from tracewell.sources.graph import closure_of

ITEMS_OF_1 = "urn LIKE 'urn:lg:tpch:column:1-%'"


def _item(t: Tables) -> DataFrame:
    """An item of order 1."""
    return t.nodes.where(f"level = 4 AND {ITEMS_OF_1}").agg(F.min("urn").alias("urn"))


def _traced(t: Tables, **k) -> trace.Trace:
    return trace.trace(t.pairs, t.closure, t.nodes, t.containment, ontology.tables(t.spark)[0], _item(t), **{"level": "dataset", "up_depth": 2, "down_depth": 2, "seconds": None} | k)


def _coarse(t: Tables, **k) -> trace.Trace:
    """Items count as datasets inside their order's dataset; only DERIVED_FROM is followed, which no item has."""
    least = lambda c: F.least(F.col(c), F.lit(3)).alias(c)
    nodes = t.nodes.withColumn("level", least("level"))
    pairs = t.pairs.withColumns({c: least(c) for c in ("source_level", "target_level")})
    return trace.trace(pairs, t.closure, nodes, t.containment, ontology.tables(t.spark)[0], _item(t), up_depth=2, down_depth=2, edge_types=["DERIVED_FROM"], seconds=None, **k)


_HOPS = (
    "u1 AS (SELECT DISTINCT source_urn AS urn FROM own WHERE target_urn IN (SELECT urn FROM s) AND source_urn NOT IN (SELECT urn FROM s)), "
    "d1 AS (SELECT DISTINCT target_urn AS urn FROM own WHERE source_urn IN (SELECT urn FROM s) AND target_urn NOT IN (SELECT urn FROM s UNION ALL SELECT urn FROM u1)), "
    "u2 AS (SELECT DISTINCT source_urn AS urn FROM own WHERE target_urn IN (SELECT urn FROM u1) AND source_urn NOT IN (SELECT urn FROM s UNION ALL SELECT urn FROM u1 UNION ALL SELECT urn FROM d1)), "
    "d2 AS (SELECT DISTINCT target_urn AS urn FROM own WHERE source_urn IN (SELECT urn FROM d1) AND target_urn NOT IN (SELECT urn FROM s UNION ALL SELECT urn FROM u1 UNION ALL SELECT urn FROM d1 UNION ALL SELECT urn FROM u2)), "
    "r AS (SELECT urn, 'start' AS side, 0 AS depth FROM s UNION ALL SELECT urn, 'upstream', 1 FROM u1 UNION ALL SELECT urn, 'downstream', 1 FROM d1 UNION ALL SELECT urn, 'upstream', 2 FROM u2 UNION ALL SELECT urn, 'downstream', 2 FROM d2)"
)
_OWN = "own AS (SELECT p.* FROM pairs p JOIN nodes a ON a.urn = p.source_urn AND a.level = 3 JOIN nodes b ON b.urn = p.target_urn AND b.level = 3)"
_TRACED = f"{_OWN}, s AS (SELECT '{ORDER}' AS urn), {_HOPS}"
_ITEM = f"f AS (SELECT MIN(urn) AS urn FROM nodes WHERE level = 4 AND {ITEMS_OF_1})"
_COARSE = (
    f"{_ITEM}, own AS (SELECT p.* FROM pairs p JOIN nodes a ON a.urn = p.source_urn AND a.level >= 3 JOIN nodes b ON b.urn = p.target_urn AND b.level >= 3 WHERE LIST_HAS_ANY(STRING_SPLIT(edge_types, ','), ['DERIVED_FROM'])), "
    f"s AS (SELECT CASE WHEN '{ORDER}' IN (SELECT source_urn FROM own UNION ALL SELECT target_urn FROM own) THEN '{ORDER}' ELSE urn END AS urn FROM f), {_HOPS}"
)
_WITH_ANCESTORS = "SELECT * FROM r UNION ALL SELECT DISTINCT a.ancestor_urn, 'ancestor', NULL FROM anc a JOIN r ON r.urn = a.urn WHERE a.ancestor_urn NOT IN (SELECT urn FROM r)"


@query(f"{_TRACED} {_WITH_ANCESTORS}", NODES, ANC, PAIRS)
def trace_whole(t):
    return _traced(t).nodes


@query(
    f"{_TRACED}, e AS (SELECT *, 1 AS hop FROM own WHERE target_urn IN (SELECT urn FROM s) OR source_urn IN (SELECT urn FROM s) UNION ALL SELECT *, 2 FROM own WHERE target_urn IN (SELECT urn FROM u1) OR source_urn IN (SELECT urn FROM d1)) "
    "SELECT source_urn, target_urn, MIN(weight) AS weight, MIN(edge_types) AS edge_types, MIN(hop) AS hop FROM e WHERE source_urn IN (SELECT urn FROM r) AND target_urn IN (SELECT urn FROM r) GROUP BY 1, 2",
    NODES,
    PAIRS,
)
def trace_whole_edges(t):
    return _traced(t).edges


@query(f"{_TRACED}, k AS (SELECT urn FROM r UNION SELECT a.ancestor_urn FROM anc a JOIN r ON r.urn = a.urn) SELECT parent_urn, child_urn FROM containment WHERE parent_urn IN (SELECT urn FROM k) AND child_urn IN (SELECT urn FROM k)", NODES, ANC, PAIRS)
def trace_whole_containment(t):
    return _traced(t).containment


@query(f"{_TRACED} SELECT urn, side, depth, (SELECT COUNT(*) FROM r) > 4 AS truncated FROM r ORDER BY depth, urn LIMIT 4", NODES, PAIRS)
def trace_budgeted(t):
    """Four nodes, the start included: the same as a whole walk that is cut afterwards."""
    out = _traced(t, max_nodes=4)
    return out.nodes.where("side <> 'ancestor'").withColumn("truncated", F.lit(out.summary.first()["reason"] == "max_nodes"))


@query(f"{_COARSE} {_WITH_ANCESTORS}", NODES, ANC, PAIRS)
def trace_inherited(t):
    return _coarse(t).nodes


@query(
    f"{_COARSE} SELECT f.urn AS focus_urn, 3 AS focus_level, 3 AS level, s.urn AS anchor_urn, f.urn <> s.urn AS inherited, CASE WHEN f.urn <> s.urn THEN f.urn END AS inherited_from, FALSE AS truncated, CAST(NULL AS VARCHAR) AS reason FROM f, s",
    NODES,
    PAIRS,
)
def trace_inherited_summary(t):
    return _coarse(t).summary.drop("hops")


_LAYER = "CASE WHEN sch LIKE 'raw%' THEN 0 WHEN sch LIKE 'st%' THEN 1 WHEN sch LIKE 'core%' THEN 2 WHEN sch LIKE 'dwh%' THEN 3 WHEN sch LIKE 'dm%' OR sch LIKE 'mart%' THEN 4 ELSE 99 END"
_NAMES = "['raw', 'staging', 'core', 'analytics', 'mart']"
_FIELDS = (
    "f0 AS (SELECT p_type AS domain, CASE p_size % 6 WHEN 0 THEN 'raw_a' WHEN 1 THEN 'stg_b' WHEN 2 THEN 'core_c' WHEN 3 THEN 'dwh_d' WHEN 4 THEN 'dm_e' ELSE 'misc_f' END AS sch, p_brand AS asset, p_partkey AS pos, "
    "CASE p_partkey % 8 WHEN 0 THEN 'id' WHEN 1 THEN 'order_pk' WHEN 2 THEN 'created_at' WHEN 3 THEN 'total_amount' WHEN 4 THEN 'price' WHEN 5 THEN 'status' WHEN 6 THEN 'col_' || p_size ELSE REPLACE(p_name, ' ', '_') END AS name, "
    "CASE p_partkey % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'string' END AS dt FROM part "
    "UNION ALL SELECT 'items', CASE l_returnflag WHEN 'R' THEN 'raw' WHEN 'A' THEN 'staging' ELSE 'mart' END, 'supplier' || l_suppkey, l_orderkey * 10 + l_linenumber, "
    "CASE l_linenumber WHEN 1 THEN 'qty_' || l_partkey WHEN 2 THEN 'sum_' || l_partkey WHEN 3 THEN 'ID' ELSE 'col_' || l_partkey END, CASE l_partkey % 2 WHEN 0 THEN 'int' ELSE 'long' END FROM lineitem), "
    f"f1 AS (SELECT 'urn:lg:schemaField:tpch.' || domain || '.' || sch || '.' || asset || '.' || name AS urn, domain, sch, asset, name, MIN(pos) AS pos, MIN(dt) AS dt, {_LAYER} AS rank FROM f0 GROUP BY domain, sch, asset, name), "
    "f2 AS (SELECT *, LOWER(name) AS n, REGEXP_MATCHES(LOWER(name), 'id|pk') AS k_id, REGEXP_MATCHES(LOWER(name), 'date|time|at') AS k_time, REGEXP_MATCHES(LOWER(name), 'amount|revenue|price|cost|value|total|sum|qty|quantity') AS k_metric, CONTAINS(LOWER(name), 'status') AS k_status, "
    "CASE WHEN REGEXP_MATCHES(name, '^col_[0-9]+$') THEN CAST(SUBSTR(name, 5) AS BIGINT) END AS k_num FROM f1)"
)


@query(
    f"{_FIELDS}, m AS (SELECT s.urn AS source_urn, t.urn AS target_urn, s.n = t.n AS by_name, s.k_id AND t.k_id AS by_id, s.k_time AND t.k_time AS by_time, s.k_metric AND t.k_metric AS by_metric, s.k_status AND t.k_status AS by_status, "
    "COALESCE(s.dt = t.dt, FALSE) AS same, COALESCE(s.dt, '') AS sd, COALESCE(t.dt, '') AS td, REGEXP_MATCHES(t.n, 'total|sum') AS sums, s.rank AS sr, t.rank AS tr "
    "FROM f2 s JOIN f2 t ON t.domain = s.domain AND t.asset = s.asset AND t.rank > s.rank AND (s.n = t.n OR (s.k_id AND t.k_id) OR (s.k_time AND t.k_time) OR (s.k_metric AND t.k_metric) OR (s.k_status AND t.k_status) OR s.k_num = t.k_num) "
    "QUALIFY ROW_NUMBER() OVER (PARTITION BY s.urn, t.sch ORDER BY t.pos, t.urn) = 1), "
    "x AS (SELECT *, CASE WHEN by_name THEN CASE WHEN same THEN 0.95 ELSE 0.85 END WHEN by_id THEN CASE WHEN same THEN 0.82 ELSE 0.72 END WHEN by_time THEN CASE WHEN same THEN 0.78 ELSE 0.68 END WHEN by_metric THEN CASE WHEN same THEN 0.80 WHEN sums THEN 0.75 ELSE 0.70 END WHEN by_status THEN 0.72 ELSE 0.68 END::DOUBLE AS confidence, "
    "CASE WHEN same THEN 'direct_copy' WHEN by_name OR by_id OR by_time THEN 'type_cast(' || sd || ' -> ' || td || ')' WHEN by_metric AND sums THEN 'sum(aggregation)' WHEN by_metric OR by_status THEN 'type_cast(' || sd || ' -> ' || td || ')' ELSE 'direct_copy' END AS transform FROM m) "
    f"SELECT 'col-lineage-' || source_urn || '-' || target_urn AS id, source_urn, target_urn, CASE transform WHEN 'direct_copy' THEN 'PRODUCES' ELSE 'TRANSFORMS' END AS edge_type, confidence, transform, {_NAMES}[sr + 1] AS source_layer, CASE tr WHEN 99 THEN 'unknown' ELSE {_NAMES}[tr + 1] END AS target_layer FROM x"
)
def column_lineage(t):
    """Parts and items as columns of tables that layers of one domain share."""
    p, i = t.read("part"), t.read("lineitem")

    def case(by: Column, names: dict, other: Column | str | None = None) -> Column:
        out = F.lit(other) if other is None or isinstance(other, str) else other
        for k, v in names.items():
            out = F.when(by == k, v).otherwise(out)
        return out

    number, digits = F.col("p_partkey"), F.col("l_partkey").cast("string")
    of_parts = p.select(
        F.col("p_type").alias("domain"), case(F.col("p_size") % 6, dict(enumerate(["raw_a", "stg_b", "core_c", "dwh_d", "dm_e"])), "misc_f").alias("schema"), F.col("p_brand").alias("asset"), number.cast("long").alias("pos"),
        case(number % 8, dict(enumerate(["id", "order_pk", "created_at", "total_amount", "price", "status", F.concat(F.lit("col_"), F.col("p_size").cast("string"))])), F.translate("p_name", " ", "_")).alias("name"), case(number % 3, {0: "int", 1: "string"}).alias("data_type"),
    )
    of_items = i.select(
        F.lit("items"), case(F.col("l_returnflag"), {"R": "raw", "A": "staging"}, "mart"), F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string")), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long"),
        case(F.col("l_linenumber"), {1: F.concat(F.lit("qty_"), digits), 2: F.concat(F.lit("sum_"), digits), 3: F.lit("ID")}, F.concat(F.lit("col_"), digits)), case(F.col("l_partkey") % 2, {0: "int"}, "long"),
    )
    fields = of_parts.union(of_items).groupBy(F.concat(F.lit("urn:lg:schemaField:tpch."), F.concat_ws(".", "domain", "schema", "asset", "name")).alias("urn")).agg(F.min("pos").alias("pos"), F.min("data_type").alias("data_type"))
    parts = fields.select("urn", "pos", "data_type", columns.field_parts(F.col("urn")).alias("p")).select("urn", "pos", "data_type", "p.*")
    return columns.inferred(parts.withColumn("layer", columns.layer_of(F.col("schema"))))


_MOVES = (
    "mv AS (SELECT 'urn:lg:tpch:system:' || n_nationkey AS child_urn, 'urn:lg:tpch:domain:' || ((n_regionkey + 1) % 5) AS new_parent_urn FROM nation WHERE n_nationkey % 5 = 0 "
    "UNION ALL SELECT 'urn:lg:tpch:container:c' || c_custkey, CASE c_custkey % 20 WHEN 0 THEN NULL ELSE 'urn:lg:tpch:system:' || ((c_nationkey + 7) % 25) END FROM customer WHERE c_custkey % 10 = 0), "
    "c2 AS (SELECT parent_urn, child_urn FROM containment WHERE child_urn NOT IN (SELECT child_urn FROM mv) UNION ALL SELECT new_parent_urn, child_urn FROM mv WHERE new_parent_urn IS NOT NULL), "
    "a2 AS (SELECT child_urn AS urn, parent_urn AS ancestor_urn, 1 AS dist FROM c2 UNION ALL SELECT a.urn, c.parent_urn, a.dist + 1 FROM a2 a JOIN c2 c ON c.child_urn = a.ancestor_urn)"
)


def _moves(t: Tables) -> DataFrame:
    """Nations go to the next region, customers to another nation or out of all; some of these nations move, too."""
    name = lambda kind, key: F.concat(F.lit(f"urn:lg:tpch:{kind}"), key.cast("string"))
    nations = t.read("nation").where("n_nationkey % 5 = 0").select(name("system:", F.col("n_nationkey")).alias("child_urn"), name("domain:", (F.col("n_regionkey") + 1) % 5).alias("new_parent_urn"))
    customers = t.read("customer").where("c_custkey % 10 = 0").select(name("container:c", F.col("c_custkey")), F.when(F.col("c_custkey") % 20 != 0, name("system:", (F.col("c_nationkey") + 7) % 25)))
    return nations.union(customers)


@query(f"{_MOVES} SELECT urn, ancestor_urn, dist FROM a2", ANC)
def closure_moved(t):
    return upkeep.applied(t.closure, upkeep.moved(t.closure, _moves(t)))


@query(
    f"{_MOVES}, up2 AS (SELECT urn, ancestor_urn FROM a2 UNION SELECT source_urn, source_urn FROM edges UNION SELECT target_urn, target_urn FROM edges), "
    "co2 AS (SELECT DISTINCT s.ancestor_urn AS source_urn, t.ancestor_urn AS target_urn, e.id, e.edge_type FROM edges e JOIN up2 s ON s.urn = e.source_urn JOIN up2 t ON t.urn = e.target_urn WHERE s.ancestor_urn <> t.ancestor_urn) "
    "SELECT source_urn, target_urn, edge_type, COUNT(*) AS n FROM co2 GROUP BY 1, 2, 3",
    EDGES,
    ANC,
)
def rollup_moved(t):
    return upkeep.repaired(t.typed_pairs, t.edges, t.closure, upkeep.moved(t.closure, _moves(t))).select("source_urn", "target_urn", "edge_type", F.col("n").cast("long").alias("n"))


_FOREST = "fo AS (SELECT urn, CAST(NULL AS VARCHAR) AS parent_urn, 0 AS depth, [display_name, urn] AS path FROM nodes WHERE urn NOT IN (SELECT child_urn FROM containment) UNION ALL SELECT n.urn, c.parent_urn, fo.depth + 1, LIST_CONCAT(fo.path, [n.display_name, n.urn]) FROM fo JOIN containment c ON c.parent_urn = fo.urn JOIN nodes n ON n.urn = c.child_urn)"


@query(f"{_FOREST}, o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY path) - 1 AS pre FROM fo), k AS (SELECT ancestor_urn, COUNT(*) AS n FROM anc GROUP BY 1) SELECT urn, parent_urn, depth, pre, pre + COALESCE(n, 0) AS last FROM o LEFT JOIN k ON k.ancestor_urn = o.urn", NODES, ANC)
def forest_intervals(t):
    return forest.intervals(t.graph.named, None, t.closure, closure_of(t.graph.chains))


_GIVEN = (
    "given AS (SELECT 'urn:lg:tpch:domain:' || r_regionkey AS urn, 'core' AS layer, 0 AS rank FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT 'urn:lg:tpch:domain:1', '__UNASSIGNED__', 0 UNION ALL SELECT 'urn:lg:tpch:domain:1', 'mart', 1 "
    "UNION ALL SELECT 'urn:lg:tpch:system:' || n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN 'stage' ELSE '__UNASSIGNED__' END, 2 FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT urn, 'parts', 3 FROM nodes WHERE entity_type = 'dataPlatform' UNION ALL SELECT 'urn:lg:tpch:container:c' || c_custkey, 'raw', 3 FROM customer WHERE c_custkey % 5 = 0)"
)


@query(
    f"{_GIVEN}, ow AS (SELECT urn, layer FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY urn ORDER BY rank, layer) AS r FROM given) WHERE r = 1 AND layer <> '__UNASSIGNED__'), "
    "w AS (SELECT n.urn, o.layer, CASE WHEN o.layer IS NOT NULL THEN n.urn END AS from_urn FROM nodes n LEFT JOIN ow o ON o.urn = n.urn WHERE n.urn NOT IN (SELECT child_urn FROM containment) "
    "UNION ALL SELECT c.child_urn, COALESCE(w.layer, o.layer), CASE WHEN w.layer IS NOT NULL THEN w.from_urn WHEN o.layer IS NOT NULL THEN c.child_urn END FROM w JOIN containment c ON c.parent_urn = w.urn LEFT JOIN ow o ON o.urn = c.child_urn) SELECT urn, layer, from_urn FROM w WHERE layer IS NOT NULL",
    NODES,
    ANC,
)
def client_layers(t):
    key = F.substring_index("urn", ":", -1)
    by = F.when(F.col("entity_type") == "domain", F.when(key.try_cast("int") % 2 == 0, F.struct(F.lit("core").alias("layer"), F.lit(0).alias("rank"))))
    by = F.when(F.col("entity_type") == "system", F.when(key.try_cast("int") % 3 == 0, F.struct(F.when(key.try_cast("int") % 2 == 0, "stage").otherwise(forest.UNASSIGNED).alias("layer"), F.lit(2).alias("rank")))).otherwise(by)
    by = F.when(F.col("entity_type") == "dataPlatform", F.struct(F.lit("parts").alias("layer"), F.lit(3).alias("rank"))).otherwise(by)
    by = F.when(F.col("urn").rlike("container:c[0-9]*[05]$"), F.struct(F.lit("raw").alias("layer"), F.lit(3).alias("rank"))).otherwise(by)
    named = t.nodes.where("level <= 2").select("urn", by.alias("by")).where("by IS NOT NULL").select("urn", "by.layer", "by.rank")
    first = t.urns("urn:lg:tpch:domain:1").select("urn", F.inline(F.array(F.struct(F.lit(forest.UNASSIGNED).alias("layer"), F.lit(0).alias("rank")), F.struct(F.lit("mart").alias("layer"), F.lit(1).alias("rank")))))
    return forest.client_layers(t.nodes, t.closure, named.union(first))


@query("SELECT '_type_' || p_brand || '_' || p_type AS rule_id, p_brand AS layer, p_type AS entity_type, 0 AS priority FROM (SELECT DISTINCT p_brand, p_type FROM part)")
def type_rules(t):
    return forest.synthetic_rules(t.read("part").groupBy(F.col("p_brand").alias("layer")).agg(F.collect_set("p_type").alias("entity_types")))


_LOGICAL = (
    "lt AS (SELECT 'r' || r_regionkey AS id, [r_name, 'r' || r_regionkey, '~'] AS path FROM region UNION ALL SELECT 'n' || n_nationkey, [r_name, 'r' || r_regionkey, n_name, 'n' || n_nationkey, '~'] FROM nation JOIN region ON r_regionkey = n_regionkey), "
    "ru AS (SELECT 'n' || n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN 'type:system' WHEN 1 THEN 'tag:F' ELSE 'tag:P' END AS key FROM nation WHERE n_nationkey % 4 < 3 UNION ALL SELECT 'r' || r_regionkey, CASE r_regionkey % 2 WHEN 0 THEN 'type:dataset' ELSE 'tag:2-HIGH' END FROM region), "
    "ke AS (SELECT urn, 'type:' || entity_type AS key FROM nodes UNION SELECT urn, 'tag:' || UNNEST(tags) FROM nodes)"
)


@query(f"{_LOGICAL} SELECT ke.urn, ARG_MIN(lt.id, lt.path) AS logical_id FROM ke JOIN ru ON ru.key = ke.key JOIN lt ON lt.id = ru.id GROUP BY 1", NODES)
def logical_assignment(t):
    """Regions and the nations in them as logical nodes, with rules of type and tag."""
    r, n = t.read("region"), t.read("nation")
    rid, nid = F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    own = r.select(rid.alias("urn"), F.col("r_name").alias("display_name")).union(n.select(nid, "n_name"))
    up = n.select(nid.alias("urn"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_urn"))
    tree = forest.intervals(own, up, hierarchy.closure(up.select("parent_urn", F.col("urn").alias("child_urn"))))
    by = F.col("n_nationkey") % 4
    rules = n.where("n_nationkey % 4 < 3").select(nid.alias("logical_id"), F.when(by == 0, "type").otherwise("tag").alias("kind"), F.when(by == 0, "system").when(by == 1, "F").otherwise("P").alias("value"))
    even = F.col("r_regionkey") % 2 == 0
    rules = rules.union(r.select(rid, F.when(even, "type").otherwise("tag"), F.when(even, "dataset").otherwise("2-HIGH")))
    return forest.logical_nodes(t.nodes, tree, rules)


_TREE = (
    "tr AS (SELECT 'urn:lg:tpch:dataset:o' || o_orderkey AS urn, o_orderkey FROM orders WHERE o_orderkey % 97 = 1), cx AS (SELECT urn, 'traced' AS shown FROM tr UNION ALL SELECT DISTINCT ancestor_urn, 'ancestor' FROM anc WHERE urn IN (SELECT urn FROM tr)), "
    "re AS (SELECT urn FROM tr WHERE o_orderkey % 2 = 1), ps AS (SELECT DISTINCT urn, 'passed' AS shown FROM anc WHERE ancestor_urn IN (SELECT urn FROM re)), kp AS (SELECT * FROM cx UNION ALL SELECT * FROM ps), "
    "ct AS (SELECT a.ancestor_urn AS urn, COUNT(*) FILTER (dist = 1) AS child_count, COUNT(*) FILTER (dist = 1 AND k.urn IS NOT NULL) AS shown_children, COUNT(*) FILTER (k.urn IS NULL) AS hidden_below FROM anc a LEFT JOIN kp k ON k.urn = a.urn GROUP BY 1)"
)


def _tree(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A tree that some orders leave, and what is expanded: some of these, and all systems."""
    key = F.substring_index("urn", ":o", -1).try_cast("long")
    traced = t.nodes.where("entity_type = 'dataset' AND urn LIKE '%:o%'").where(key % 97 == 1).select("urn")
    expanded = traced.where(key % 2 == 1).union(t.nodes.where("entity_type = 'system'").select("urn"))
    return forest.traced_tree(t.nodes, hierarchy.parents(t.containment), t.closure, traced, expanded), expanded


@query(f"{_TREE} SELECT k.urn, c.parent_urn, k.shown, COALESCE(child_count, 0) AS child_count, COALESCE(shown_children, 0) AS shown_children, COALESCE(hidden_below, 0) AS hidden_below, COALESCE(shown_children > 0 AND shown_children < child_count, FALSE) AS residual FROM kp k LEFT JOIN containment c ON c.child_urn = k.urn LEFT JOIN ct ON ct.urn = k.urn", ANC)
def traced_tree(t):
    return _tree(t)[0]


@query(
    f"{_TREE}, op AS (SELECT k.urn, shown_children < child_count AS part FROM kp k JOIN ct ON ct.urn = k.urn WHERE shown_children > 0 AND (k.urn LIKE '%:system:%' OR k.urn IN (SELECT urn FROM re))), "
    "pr AS (SELECT source_urn, target_urn FROM pairs p JOIN nodes a ON a.urn = p.source_urn AND a.level = 1 JOIN nodes b ON b.urn = p.target_urn AND b.level = 1) "
    "SELECT source_urn, target_urn, (s.urn IS NOT NULL OR t.urn IS NOT NULL) AND NOT (COALESCE(s.part, FALSE) OR COALESCE(t.part, FALSE)) AND 'urn:lg:tpch:system:1' NOT IN (source_urn, target_urn) AS delegated, (COALESCE(s.part, FALSE) OR COALESCE(t.part, FALSE)) AND 'urn:lg:tpch:system:1' NOT IN (source_urn, target_urn) AS residual FROM pr LEFT JOIN op s ON s.urn = source_urn LEFT JOIN op t ON t.urn = target_urn",
    NODES,
    ANC,
    PAIRS,
)
def edges_delegated(t):
    tree, expanded = _tree(t)
    pairs = t.pairs.where("source_level = 1 AND target_level = 1").select("source_urn", "target_urn")
    return forest.delegated(pairs, tree, expanded, t.urns("urn:lg:tpch:system:1"))


@query(
    "sd AS (SELECT 'urn:lg:tpch:dataset:o' || o_orderkey AS urn, CASE o_orderkey % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'upstream' ELSE 'downstream' END AS side FROM orders), hi AS (SELECT DISTINCT urn FROM anc WHERE ancestor_urn IN (SELECT 'urn:lg:tpch:system:' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0)) "
    "SELECT e.id FROM edges e JOIN sd a ON a.urn = e.source_urn JOIN sd b ON b.urn = e.target_urn WHERE edge_type = 'DERIVED_FROM' AND NOT ('upstream' IN (a.side, b.side) AND 'downstream' NOT IN (a.side, b.side)) AND e.source_urn NOT IN (SELECT urn FROM hi) AND e.target_urn NOT IN (SELECT urn FROM hi)",
    EDGES,
    ANC,
)
def trace_edges_visible(t):
    key = F.substring_index("urn", ":o", -1).try_cast("long")
    orders = t.nodes.where("entity_type = 'dataset' AND urn LIKE '%:o%'")
    sides = orders.select("urn", F.when(key % 3 == 0, "start").when(key % 3 == 1, "upstream").otherwise("downstream").alias("side"))
    collapsed = t.nodes.where("entity_type = 'system'").where(F.substring_index("urn", ":", -1).try_cast("int") % 4 == 0).select("urn")
    return forest.visible_edges(t.edges.where("edge_type = 'DERIVED_FROM'"), sides, t.closure, collapsed, upstream=False).select("id")


SCOPE = {"all": [{"any": [{"urn_patterns": ["urn:lg:TPCH:container:c1*", "*:dataset:p?", "urn:lg:tpch:dom?in:3"]}, {"root_urns": ["urn:lg:tpch:system:1", "urn:lg:tpch:dataplatform:Brand#11"]}, {"include_tags": ["BUILDING", "1-URGENT"]}]}, {"exclude_tags": ["F"]}, {"not": {"entity_types": ["column"]}}]}


@query("SELECT urn FROM nodes WHERE (urn LIKE 'urn:lg:tpch:container:c1%' OR urn LIKE '%:dataset:p_' OR urn = 'urn:lg:tpch:domain:3' OR urn IN ('urn:lg:tpch:system:1', 'urn:lg:tpch:dataplatform:Brand#11') OR urn IN (SELECT urn FROM anc WHERE ancestor_urn IN ('urn:lg:tpch:system:1', 'urn:lg:tpch:dataplatform:Brand#11')) OR LIST_HAS_ANY(tags, ['BUILDING', '1-URGENT'])) AND NOT LIST_CONTAINS(tags, 'F') AND entity_type <> 'column'", NODES, ANC)
def scope_filter(t):
    return scope.scoped(t.nodes, t.closure, SCOPE).select("urn")


@query("pt AS (SELECT 'urn:lg:tpch:Container:c' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '*' ELSE '?' END AS pattern FROM customer UNION ALL SELECT '*:dataPlatform:*1' UNION ALL SELECT '*system:?') SELECT urn, pattern FROM nodes JOIN pt ON LOWER(urn) LIKE REPLACE(REPLACE(LOWER(pattern), '*', '%'), '?', '_') WHERE level IN (1, 2)", NODES)
def pattern_matches(t):
    """All urns against a pattern for each customer and two more."""
    key = F.col("c_custkey")
    tail = F.when(key % 3 == 0, "").when(key % 3 == 1, "*").otherwise("?")
    own = t.read("customer").select(F.concat(F.lit("urn:lg:tpch:Container:c"), key.cast("string"), tail).alias("pattern"))
    more = t.spark.createDataFrame([("*:dataPlatform:*1",), ("*system:?",)], "pattern string")
    return scope.matched(t.nodes, own.union(more))


@query("o AS (SELECT p.* FROM pairs p JOIN nodes a ON a.urn = p.source_urn AND a.level = 1 JOIN nodes b ON b.urn = p.target_urn AND b.level = 0) SELECT source_urn, target_urn, weight, edge_types, CAST((SELECT SUM(weight) FROM o) AS BIGINT) AS total FROM o", NODES, PAIRS)
def pairs_listed(t):
    """From systems and platforms to domains, the heaviest first, with the weight of all."""
    at = lambda n: t.nodes.where(F.col("level") == n).select("urn")
    return rollup.listed_between(t.pairs, at(1), at(0))


@query(f"{_walk('downstream', PART, 4).replace('JOIN edges e', 'JOIN flows e')} SELECT urn, MIN(depth) AS depth FROM w GROUP BY 1 HAVING MIN(depth) > 0".replace("w AS (", "flows AS (SELECT * FROM edges WHERE edge_type IN ('FLOWS_TO')), w AS (", 1), EDGES)
def downstream_of_type(t):
    return traversal.reach(t.edges, t.urns(PART), "downstream", 4, ["FLOWS_TO"])


@query("SELECT a.urn, a.dist FROM anc a JOIN nodes n ON n.urn = a.urn WHERE a.ancestor_urn = 'urn:lg:tpch:domain:1' AND a.dist <= 3 AND n.entity_type IN ('container', 'dataset')", NODES, ANC)
def descendants_of_type(t):
    return hierarchy.descendants(t.closure, DOMAIN, 3, t.nodes, ["container", "dataset"])


@query(f"{_walk('downstream', ORDER, 2)}, {_walk('upstream', ORDER, 2).replace('w AS', 'w2 AS').replace('FROM w ', 'FROM w2 ').replace('w.', 'w2.')} SELECT id FROM edges WHERE source_urn IN (SELECT urn FROM w) OR target_urn IN (SELECT urn FROM w2)", EDGES)
def transitive_edges_both(t):
    return traversal.incident_edges(t.edges, t.urns(ORDER), "both", 2).select("id")
