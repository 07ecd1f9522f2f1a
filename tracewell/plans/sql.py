"""Common table expressions of the SQL twins: the graph that the order tables describe."""

ITEM = "'urn:lg:tpch:column:' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber"

ITEMS = "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, MIN(l_discount) AS l_discount, MIN(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2, 3, 4)"

NODES = f"""nodes AS (
SELECT 'urn:lg:tpch:domain:' || r_regionkey AS urn, 'domain' AS entity_type, 0 AS level, r_name AS display_name, CAST([] AS VARCHAR[]) AS tags FROM region
UNION ALL SELECT 'urn:lg:tpch:system:' || n_nationkey, 'system', 1, n_name, [] FROM nation
UNION ALL SELECT DISTINCT 'urn:lg:tpch:dataplatform:' || p_brand, 'dataPlatform', 1, p_brand, [] FROM part
UNION ALL SELECT 'urn:lg:tpch:container:c' || c_custkey, 'container', 2, c_name, [c_mktsegment] FROM customer
UNION ALL SELECT 'urn:lg:tpch:container:s' || s_suppkey, 'container', 2, s_name, [] FROM supplier
UNION ALL SELECT 'urn:lg:tpch:dataset:o' || o_orderkey, 'dataset', 3, 'order-' || o_orderkey, [o_orderstatus, o_orderpriority] FROM orders
UNION ALL SELECT 'urn:lg:tpch:dataset:p' || p_partkey, 'dataset', 3, p_name, [p_type] FROM part
UNION ALL SELECT {ITEM}, 'column', 4, l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber, [l_returnflag] FROM {ITEMS})"""

EDGES = f"""edges AS (SELECT source_urn || '|' || edge_type || '|' || target_urn AS id, * FROM (
SELECT DISTINCT 'urn:lg:tpch:container:s' || l_suppkey AS source_urn, 'urn:lg:tpch:dataset:p' || l_partkey AS target_urn, 'PRODUCES' AS edge_type, CAST(NULL AS DOUBLE) AS confidence FROM lineitem
UNION ALL SELECT 'urn:lg:tpch:dataset:p' || l_partkey, {ITEM}, 'FLOWS_TO', ROUND(1 - l_discount, 2) FROM {ITEMS}
UNION ALL SELECT 'urn:lg:tpch:dataset:o' || o_orderkey, 'urn:lg:tpch:dataset:o' || nxt, 'DERIVED_FROM', NULL
FROM (SELECT o_orderkey, LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL))"""

ANC = f"""containment AS (
SELECT 'urn:lg:tpch:domain:' || n_regionkey AS parent_urn, 'urn:lg:tpch:system:' || n_nationkey AS child_urn FROM nation
UNION ALL SELECT 'urn:lg:tpch:system:' || c_nationkey, 'urn:lg:tpch:container:c' || c_custkey FROM customer
UNION ALL SELECT 'urn:lg:tpch:system:' || s_nationkey, 'urn:lg:tpch:container:s' || s_suppkey FROM supplier
UNION ALL SELECT 'urn:lg:tpch:container:c' || o_custkey, 'urn:lg:tpch:dataset:o' || o_orderkey FROM orders
UNION ALL SELECT 'urn:lg:tpch:dataset:o' || l_orderkey, {ITEM} FROM {ITEMS}
UNION ALL SELECT 'urn:lg:tpch:dataplatform:' || p_brand, 'urn:lg:tpch:dataset:p' || p_partkey FROM part),
anc AS (SELECT child_urn AS urn, parent_urn AS ancestor_urn, 1 AS dist FROM containment
UNION ALL SELECT a.urn, c.parent_urn, a.dist + 1 FROM anc a JOIN containment c ON c.child_urn = a.ancestor_urn)"""

PAIRS = """up AS (SELECT urn, ancestor_urn FROM anc UNION ALL SELECT source_urn, source_urn FROM edges GROUP BY 1, 2
UNION SELECT target_urn, target_urn FROM edges),
contrib AS (SELECT DISTINCT s.ancestor_urn AS source_urn, t.ancestor_urn AS target_urn, e.id, e.edge_type
FROM edges e JOIN up s ON s.urn = e.source_urn JOIN up t ON t.urn = e.target_urn WHERE s.ancestor_urn <> t.ancestor_urn),
pairs AS (SELECT source_urn, target_urn, COUNT(*) AS weight, STRING_AGG(DISTINCT edge_type, ',' ORDER BY edge_type) AS edge_types FROM contrib GROUP BY 1, 2)"""


def with_ctes(sql: str, *ctes: str) -> str:
    """sql behind the expressions it needs; it may begin with more of them."""
    need = list(ctes)
    if PAIRS in need:
        need = [x for x in (NODES,) if x in need] + [EDGES, ANC, PAIRS]
    own = "" if sql.lstrip().upper().startswith(("SELECT", "WITH")) else sql
    if own:
        return f"WITH RECURSIVE {', '.join([*need, own])}"
    if sql.lstrip().upper().startswith("WITH"):
        return f"WITH RECURSIVE {', '.join([*need, sql.lstrip()[4:]])}"
    return f"WITH RECURSIVE {', '.join(need)} {sql}" if need else sql
