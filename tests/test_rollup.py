"""Deltas of the rollup on a hand-made graph, against a plain recount."""

from collections import Counter

from tracewell.operators import hierarchy, rollup

PARENT = {"a1": "a", "a2": "a", "b1": "b", "b2": "b", "a": "top", "b": "top"}
EDGES = [("e1", "a1", "b1", "FLOWS"), ("e2", "a1", "b1", "MAKES"), ("e3", "a2", "b2", "FLOWS"), ("e4", "a1", "a2", "FLOWS"), ("e5", "stray", "b1", "FLOWS")]


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "id string, source_urn string, target_urn string, edge_type string")


def chain(urn):
    return [urn] + (chain(PARENT[urn]) if urn in PARENT else [])


def recount(rows):
    out = Counter()
    for _, s, t, kind in {r[0]: r for r in rows}.values():
        out.update((x, y, kind) for x in chain(s) for y in chain(t) if x != y)
    return dict(out)


def rows_of(df):
    return {(r.source_urn, r.target_urn, r.edge_type): r.n for r in df.collect()}


def closure_of(spark):
    return hierarchy.closure(spark.createDataFrame([(p, c) for c, p in PARENT.items()], "parent_urn string, child_urn string"))


def test_typed_counts_an_edge_id_once(spark):
    assert rows_of(rollup.typed(edges_of(spark, [*EDGES, EDGES[0]]), closure_of(spark))) == recount(EDGES)


def test_added_and_deleted_edges(spark):
    closure, before = closure_of(spark), edges_of(spark, EDGES)
    typed = rollup.typed(before, closure)
    new = [EDGES[0], ("e6", "b2", "a1", "FLOWS"), ("e6", "b2", "a1", "FLOWS")]
    assert rows_of(rollup.with_edges(typed, before, edges_of(spark, new), closure)) == recount([*EDGES, new[1]])
    gone = edges_of(spark, [EDGES[1], EDGES[3], ("none", "a1", "b1", "FLOWS")])
    assert rows_of(rollup.without_edges(typed, before, gone, closure)) == recount([EDGES[0], EDGES[2], EDGES[4]])
    assert rows_of(rollup.without_edges(typed, before, before, closure)) == {}
    assert rows_of(rollup.with_edges(typed, before, before.limit(0), closure)) == recount(EDGES)


def test_pairs_of_two_levels(spark):
    levels = {"top": 0, "a": 1, "b": 1, "a1": 2, "a2": 2, "b1": 2, "b2": 2}
    nodes = spark.createDataFrame(list(levels.items()), "urn string, level int")
    closure = closure_of(spark)
    want = Counter()
    for (s, t, _), n in recount(EDGES).items():
        if levels.get(s) == 1 and levels.get(t) == 2:
            want[s, t] += n
    got = rollup.at_levels(edges_of(spark, [*EDGES, EDGES[2]]), closure, nodes, 1, 2)
    assert {(r.source_urn, r.target_urn): r.weight for r in got.collect()} == dict(want)
    only = rollup.at_levels(edges_of(spark, EDGES), closure, nodes, 1, 2, nodes.where("urn = 'b'"))
    assert {(r.source_urn, r.target_urn): r.weight for r in only.collect()} == {k: v for k, v in want.items() if k[0] == "b"}
    pairs = rollup.with_levels(rollup.rollup(edges_of(spark, EDGES), closure), nodes)
    assert {(r.source_urn, r.source_level, r.target_level) for r in pairs.where("source_urn = 'stray'").collect()} >= {("stray", None, 2)}
