"""Whole traces on hand-made graphs: budgets, inherited anchors, levels, cycles."""

import pytest

from tracewell.operators import hierarchy, trace

#: Folders (level 1) that hold tables (level 2), some in another table.
PARENT = {"t1": "f1", "t2": "f1", "t3": "f2", "part": "t1", "deep": "part", "t4": "f2", "t5": "f2"}
LEVEL = {"f1": 1, "f2": 1, "t1": 2, "t2": 2, "t3": 2, "t4": 2, "t5": 2, "part": 2, "deep": 2}
PAIRS = [("t1", "t2", 2, "FLOWS,MAKES"), ("t2", "t3", 1, "FLOWS"), ("t3", "t1", 1, "FLOWS"), ("t4", "t1", 4, "MAKES"), ("t5", "t4", 1, "MAKES"), ("t1", "t5", 1, "OTHER")]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(u, "folder" if n == 1 else "table", n) for u, n in LEVEL.items()], "urn string, entity_type string, level int")
    containment = spark.createDataFrame([(p, c) for c, p in PARENT.items()], "parent_urn string, child_urn string")
    pairs = spark.createDataFrame([(*p, 2, 2) for p in PAIRS], "source_urn string, target_urn string, weight long, edge_types string, source_level int, target_level int")
    types = spark.createDataFrame([("folder", 1), ("table", 2)], "type_id string, level int")
    return pairs, hierarchy.closure(containment), nodes, containment, types


def traced(spark, graph, urn, **k):
    return trace.trace(*graph, spark.createDataFrame([(urn,)], "urn string"), **{"seconds": None} | k)


def found(t):
    return {r.urn: (r.side, r.depth) for r in t.nodes.collect() if r.side != "ancestor"}


def plain(start, up, down, types=None):
    """Breadth first, both sides in turn; a node met by both is upstream."""
    pairs = [(s, t) for s, t, _, kinds in PAIRS if not types or set(types) & set(kinds.split(","))]
    seen, fronts = {start: ("start", 0)}, {"upstream": {start}, "downstream": {start}}
    for hop in range(1, max(up, down) + 1):
        new = {}
        for side, most in (("upstream", up), ("downstream", down)):
            met = {(s if side == "upstream" else t) for s, t in pairs if (t if side == "upstream" else s) in fronts[side]} if hop <= most else set()
            new[side] = {u for u in met if u not in seen}
            seen |= {u: (side, hop) for u in new[side]}
        fronts = new
    return seen


@pytest.mark.parametrize(("up", "down", "types"), [(1, 1, None), (3, 3, None), (0, 2, None), (2, 0, ["MAKES"]), (5, 5, ["FLOWS"])])
def test_walk_and_cycles(spark, graph, up, down, types):
    out = traced(spark, graph, "t1", up_depth=up, down_depth=down, edge_types=types)
    assert found(out) == plain("t1", up, down, types)
    row = out.summary.first()
    assert (row.anchor_urn, row.inherited, row.truncated, row.reason) == ("t1", False, False, None)


@pytest.mark.parametrize("budget", [1, 2, 3, 4, 5])
def test_budget_is_a_whole_walk_cut_afterwards(spark, graph, budget):
    whole = sorted(plain("t1", 4, 4).items(), key=lambda x: (x[1][1], x[0]))
    out = traced(spark, graph, "t1", up_depth=4, down_depth=4, max_nodes=budget)
    assert found(out) == dict(whole[:budget])
    row = out.summary.first()
    last = whole[budget - 1][1][1]
    # A budget that is just spent counts, too: what is behind it is not read.
    assert (row.truncated, row.reason) == (True, "max_nodes")
    assert out.hops == (last if budget == len(whole) or last < whole[budget][1][1] else whole[budget][1][1])
    ends = {x for r in out.edges.collect() for x in (r.source_urn, r.target_urn)}
    assert ends <= set(found(out))


def test_no_hop_behind_a_spent_budget(spark, graph, monkeypatch):
    """The pairs are read once for each hop up to where the budget ends."""
    read, cut = [], trace.cut
    monkeypatch.setattr(trace, "cut", lambda df: read.append(df.columns) or cut(df))
    out = traced(spark, graph, "t1", up_depth=9, down_depth=9, max_nodes=3)
    assert out.hops == sum("edge_types" in c for c in read) == 1


def test_inherited_anchor_and_hierarchy(spark, graph):
    """A table in a table without lineage of its own takes the nearest above it that has some."""
    out = traced(spark, graph, "deep", up_depth=1, down_depth=1)
    row = out.summary.first()
    assert (row.anchor_urn, row.inherited, row.inherited_from, row.level) == ("t1", True, "deep", 2)
    assert found(out) == plain("t1", 1, 1)
    assert {r.urn for r in out.nodes.where("side = 'ancestor'").collect()} == {"f1", "f2"}
    inside = {(r.parent_urn, r.child_urn) for r in out.containment.collect()}
    assert inside == {(PARENT[u], u) for u in found(out)}
    alone = traced(spark, graph, "deep", inherited=False)
    assert found(alone) == {"deep": ("start", 0)} and not alone.summary.first().inherited


@pytest.mark.parametrize(("urn", "level", "want"), [("t1", "auto", 2), ("t1", "1", 1), ("t1", "folder", 1), ("t1", "nonsense", 2), ("gone", "auto", 0), ("gone", "2", 2)])
def test_levels(spark, graph, urn, level, want):
    row = traced(spark, graph, urn, level=level).summary.first()
    assert row.level == want and row.anchor_urn == ("f1" if want == 1 else urn)


def test_time_is_a_budget_too(spark, graph):
    row = traced(spark, graph, "t1", up_depth=3, seconds=-1.0).summary.first()
    assert (row.truncated, row.reason, row.hops) == (True, "timeout", 0)
