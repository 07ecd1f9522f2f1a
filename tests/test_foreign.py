"""Foreign graphs: dumps read in pieces, filters that reach the reader, mapping of fields, suggestions."""

import json

import pytest

from tracewell.sources import foreign, graph

NODES = [
    {"type": "node", "id": "1", "labels": ["Table", "Asset"], "properties": {"uuid": "u1", "name": "orders", "labels": ["a", "b"], "props": {"x": 1, "k": "own"}, "k": "outer", "extra": True}},
    {"type": "node", "id": "2", "labels": ["Column"], "properties": {"uuid": "u2", "name": "id\nwith a break", "labels": '["c"]', "props": '{"y": "2"}'}},
    {"type": "node", "id": "3", "labels": [], "properties": {"uuid": "u3", "labels": "no json", "props": "nor this", "kind": "Report"}},
    {"type": "node", "id": "4", "labels": ["Column"]},
]
EDGES = [
    {"type": "relationship", "id": "9", "label": "HAS", "start": {"id": "1"}, "end": {"id": "2"}, "properties": {"id": "e1", "confidence": 0.5}},
    {"type": "relationship", "id": "10", "label": "HAS", "start": {"id": "1"}, "end": {"id": "3"}},
    {"type": "relationship", "id": "11", "label": "HAS", "start": {"id": "1"}, "end": {"id": "gone"}},
]
MAPPING = {"urn": "uuid", "display_name": "name", "tags": "labels", "properties": "props"}


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    path = tmp_path_factory.mktemp("dump")
    lines = [json.dumps(x) for x in [*NODES, *EDGES]]
    (path / "a.jsonl").write_text("\n".join(lines[:3]) + "\n\n")
    (path / "b.jsonl").write_text("\n".join(lines[3:]))
    (path / "_SUCCESS").write_text("")
    return str(path)


@pytest.mark.parametrize("split", [7, 100, 1 << 20])
def test_every_line_once_in_any_pieces(spark, dump, split):
    nodes = foreign.read_dump(spark, dump, split=split)
    assert nodes.rdd.getNumPartitions() > (2 if split < 1000 else 0)
    assert sorted((r.id, r.label, tuple(r.labels)) for r in nodes.collect()) == [(x["id"], next(iter(x["labels"]), None), tuple(x["labels"])) for x in NODES]
    edges = foreign.read_dump(spark, dump, "relationship", split)
    assert sorted((r.id, r.start_id, r.end_id) for r in edges.collect()) == sorted((x["id"], x["start"]["id"], x["end"]["id"]) for x in EDGES)


def test_label_filters_reach_the_reader(spark, dump, capsys):
    nodes = foreign.read_dump(spark, dump)
    asked = nodes.where("label = 'Column' AND id <> '4'")
    assert [r.id for r in asked.collect()] == ["2"]
    asked.explain("formatted")
    plan = capsys.readouterr().out
    assert "Filter" in plan and "(label#" not in plan.split("Condition :")[1].split("\n")[0].replace("isnotnull(label", "")
    assert sorted(r.id for r in nodes.where("label IN ('Column', 'Table')").collect()) == ["1", "2", "4"]
    reader = foreign.DumpReader({"path": "file:///x"}, "node")
    rest = list(reader.pushFilters([foreign.EqualTo(("label",), "A"), foreign.EqualTo(("id",), "1"), foreign.In(("label",), ("A", "B"))]))
    assert reader.labels == ["A"] and rest == [foreign.EqualTo(("id",), "1")]


def test_mapping(spark, dump):
    levels = spark.createDataFrame([("Table", 3), ("Column", 4)], "type_id string, level int")
    raw = foreign.read_dump(spark, dump)
    got = {r.foreign_id: r for r in foreign.map_nodes(raw, MAPPING, levels).collect()}
    assert (got["1"].urn, got["1"].entity_type, got["1"].level, got["1"].display_name, got["1"].tags) == ("u1", "Table", 3, "orders", ["a", "b"])
    assert got["1"].properties == {"x": "1", "k": "own", "extra": "true"}
    assert (got["2"].display_name, got["2"].tags, got["2"].properties) == ("id\nwith a break", ["c"], {"y": "2"})
    assert (got["3"].entity_type, got["3"].level, got["3"].tags, got["3"].properties) == ("unknown", None, [], {"kind": "Report"})
    assert (got["4"].urn, got["4"].properties) == ("", {})
    typed = {r.foreign_id: r for r in foreign.map_nodes(raw, MAPPING, levels, "kind", collect=False).collect()}
    assert typed["3"].entity_type == "Report" and typed["3"].properties == {} and typed["1"].entity_type == "unknown"
    edges = foreign.map_edges(foreign.read_dump(spark, dump, "relationship"), foreign.map_nodes(raw, MAPPING, levels), {})
    assert sorted((r.id, r.source_urn, r.target_urn, r.edge_type, r.confidence) for r in edges.collect()) == [("e1", "u1", "u2", "HAS", 0.5), ("u1|HAS|u3", "u1", "u3", "HAS", None)]
    assert foreign.foreign_field(MAPPING, "urn") == "uuid" and foreign.foreign_field({}, "layer") == "layerAssignment" and foreign.foreign_field({}, "other") == "other"


def test_suggestions(spark, dump):
    got = {(r.label, r.field): r.key for r in foreign.suggested(foreign.property_keys(foreign.read_dump(spark, dump))).collect()}
    assert got[None, "urn"] == got["Column", "urn"] == "uuid" and got["Table", "tags"] == "labels" and ("Asset", "display_name") in got and (None, "description") not in got


def test_seed_to_dump_and_back(spark, tmp_path):
    """A seed file's graph, written as a dump and mapped back, is the same."""
    seed = {"nodes": [{"urn": "u:1", "entityType": "Table", "displayName": "ä", "tags": ["x"], "properties": {"p": "1"}}, {"urn": "u:2", "entityType": "Column", "displayName": "c", "tags": [], "properties": {}}], "edges": [{"id": "e", "sourceUrn": "u:1", "targetUrn": "u:2", "edgeType": "HAS", "confidence": 0.25}]}
    (tmp_path / "seed.json").write_text(json.dumps(seed))
    nodes, edges = graph.read_seed(spark, str(tmp_path / "seed.json"), {"Table": 3, "Column": 4})
    foreign.write_dump(nodes, edges, str(tmp_path / "dump"))
    levels = spark.createDataFrame([("Table", 3), ("Column", 4)], "type_id string, level int")
    back = foreign.map_nodes(foreign.read_dump(spark, str(tmp_path / "dump")), {}, levels)
    assert sorted(map(str, back.select(nodes.columns).collect())) == sorted(map(str, nodes.collect()))
    again = foreign.map_edges(foreign.read_dump(spark, str(tmp_path / "dump"), "relationship"), back, {})
    assert [tuple(r) for r in again.select(edges.columns).collect()] == [tuple(r) for r in edges.collect()]
