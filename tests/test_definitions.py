"""Operators without a query of their own, on hand-made tables."""

from pyspark.sql import functions as F

from tracewell.functions import scalar
from tracewell.operators import catalog, ontology
from tracewell.sources import graph

TYPES = [("a", 0, ["b"]), ("b", 1, ["a", "c"]), ("c", 2, [])]


def test_last_layer_with_a_type_wins(spark):
    base = spark.createDataFrame([("Table", 1), ("view", 2)], "type_id string, level int")
    own = spark.createDataFrame([("table", 7)], "type_id string, level int")
    out = {(r.type_id, r.level, r.source) for r in ontology.resolve(("system", base), ("own", own)).collect()}
    assert out == {("table", 7, "own"), ("view", 2, "system")}


def test_containment_cycles_and_allowed_children(spark):
    types = spark.createDataFrame(TYPES, ontology.ENTITY)
    assert {r.type_id for r in ontology.containment_cycles(types).collect()} == {"a", "b"}
    assert [tuple(r) for r in ontology.allowed_children(types, "b").collect()] == [("a", True), ("c", True), ("b", False)]
    assert all(r.allowed for r in ontology.allowed_children(types, "c").collect())


def test_foreign_nodes_by_mapping(spark):
    assert graph.merge_mappings({"urn": "id", "tags": None}, {"urn": None, "tags": "labels"}) == {"urn": "id", "tags": "labels"}
    rows = spark.createDataFrame([({"id": "u1", "kind": "table", "labels": '["x"]', "owner": "me"},), ({"id": "u2", "kind": "view"},)], "props map<string,string>")
    nodes = graph.map_foreign_nodes(rows, {"urn": "id", "tags": "labels"}, "kind")
    out = {r.urn: (r.entity_type, r.display_name, r.tags, r.properties) for r in nodes.collect()}
    assert out == {"u1": ("table", "u1", ["x"], {"owner": "me"}), "u2": ("view", "u2", [], {})}
    found = {r.entity_type: (r.n, r.samples, r.property_keys) for r in graph.discover_schema(nodes).collect()}
    assert found == {"table": (1, "u1", "owner"), "view": (1, "u2", "")}


def test_dangling_edges_and_pruned_layout(spark, tmp_path):
    nodes = spark.createDataFrame([("u", "t"), ("v", "s")], "urn string, entity_type string")
    edges = spark.createDataFrame([("u", "v", "E"), ("u", "gone", "E"), (None, "v", "E")], "source_urn string, target_urn string, edge_type string")
    kept = graph.drop_dangling(edges, nodes)
    assert [tuple(r) for r in kept.collect()] == [("u", "v", "E")]
    graph.write_graph(graph.Graph(nodes, kept, kept.select("source_urn")), str(tmp_path))
    read = spark.read.parquet(f"{tmp_path}/nodes").where("entity_type = 't'")
    assert [r.urn for r in read.collect()] == ["u"]
    assert "PartitionFilters: [isnotnull(entity_type" in read._jdf.queryExecution().toString()


def test_job_summary(spark):
    jobs = spark.createDataFrame([("completed",)] * 3 + [("failed",), ("running",)], "status string")
    assert {tuple(r) for r in catalog.job_summary(jobs).collect()} == {("completed", 3, 75.0), ("failed", 1, 75.0), ("running", 1, 75.0)}


def test_scalars(spark):
    names = spark.createDataFrame([("my_tableName",), ("!!",), (None,)], "x string")
    assert [tuple(r) for r in names.select(scalar.humanise(F.col("x")), scalar.sanitise(F.col("x"), "none")).collect()] == [("My Table Name", "my_tableName"), ("!!", "none"), (None, None)]
    urns = spark.createDataFrame([("urn:a:b",), ("urn:a",), ("x",), (None,)], "x string")
    assert [r[0] for r in urns.select(scalar.valid_urn(F.col("x"))).collect()] == [True, False, False, False]
    times = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:20:00",), ("2024-01-01 01:00:00",), (None,)], "x string")
    age = scalar.age_seconds(F.col("x").cast("timestamp"), F.lit("2024-01-01 00:20:30").cast("timestamp"))
    assert [tuple(r) for r in times.select(age, scalar.service_health(age)).collect()][:3] == [(1230, "unreachable"), (30, "healthy"), (0, "healthy")]
