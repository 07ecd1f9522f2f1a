"""Chains and what is counted with them, against the closure and rollup of the same graph; on tables with odd rows, too."""

import pytest
from pyspark.sql import functions as F

from tracewell.operators import hierarchy, rollup
from tracewell.plans import catalogue
from tracewell.sources import graph


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark, sf_dir, tmp_path_factory):
    """A third of an sf's tables with doubled rows, a customer of two nations, keys without a row, and null keys."""
    out = str(tmp_path_factory.mktemp("odd"))
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    one = lambda df, **c: df.limit(1).withColumns({k: F.lit(v).cast(df.schema[k].dataType) for k, v in c.items()})
    t = {n: read(n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    t["lineitem"] = t["lineitem"].where("l_orderkey % 3 = 0")
    t["lineitem"] = t["lineitem"].union(t["lineitem"].limit(5)).union(one(t["lineitem"], l_orderkey=-1, l_linenumber=1)).union(one(t["lineitem"], l_partkey=-1, l_linenumber=99))
    t["orders"] = t["orders"].where("o_orderkey % 3 < 2").union(one(t["orders"], o_orderkey=-7, o_custkey=-7)).union(one(t["orders"], o_orderkey=-8, o_custkey=None))
    t["orders"] = t["orders"].union(t["orders"].where("o_orderkey % 10 = 0").limit(3))
    t["customer"] = t["customer"].union(one(t["customer"].where("c_custkey = 1"), c_nationkey=3)).union(one(t["customer"].where("c_custkey = 2"), c_nationkey=77))
    for n, df in t.items():
        df.coalesce(1).write.parquet(f"{out}/{n}.parquet")
    return out


def both(spark, d):
    g = graph.TableGraph(spark, d)
    return g, graph.closure_of(g.ups).select("urn", "ancestor_urn", "dist"), hierarchy.closure(g.containment).select("urn", "ancestor_urn", "dist")


def test_closure_of_chains(spark, odd):
    _, got, want = both(spark, odd)
    assert rows_of(got) == rows_of(want)


def test_counts_and_levels_of_linked_edges(spark, odd):
    g, _, closure = both(spark, odd)
    linked = rollup.linked(g.targeted, g.chains)
    typed = rollup.typed(g.edges, closure)
    assert rows_of(rollup.typed_of(linked)) == rows_of(typed)
    want = rollup.with_levels(rollup.folded(typed), g.nodes.select("urn", "level").distinct())
    assert rows_of(rollup.pairs_of(linked, graph.EDGE_TYPES)) == rows_of(want)


@pytest.mark.parametrize("sign", [1, -1])
def test_changed_edges(spark, odd, sign):
    g, _, closure = both(spark, odd)
    old, other = ("edge_type <> 'DERIVED_FROM'", "edge_type <> 'PRODUCES'") if sign > 0 else ("edge_type <> 'FLOWS_TO'", "edge_type <> 'PRODUCES'")
    got = rollup.changed(g.targeted.where(old), g.targeted.where(other), g.chains, graph.EDGE_TYPES, sign)
    left = g.edges if sign > 0 else g.edges.where("edge_type = 'PRODUCES'")
    assert rows_of(got) == rows_of(rollup.folded(rollup.typed(left, closure)))


def test_anchors_of_chains(spark, odd):
    g, _, closure = both(spark, odd)
    assert rows_of(hierarchy.anchors_in(g.rows, 1)) == rows_of(hierarchy.anchors_at_granularity(closure, g.nodes, 1).join(g.nodes.groupBy("urn").count(), "urn").select("urn", "anchor").distinct().join(g.nodes.select("urn"), "urn").select("urn", "anchor"))


def test_projected_edges(spark, odd):
    g, _, closure = both(spark, odd)
    nodes = g.nodes.select("urn", "level", "entity_type").distinct()
    at = lambda chain: hierarchy.first_in(chain, lambda x: x["level"] <= 1)
    columns = ["source_urn", "target_urn", "n", "confidence"]
    want = rollup.anchored(g.edges, hierarchy.anchors_at_granularity(closure, nodes, 1))
    assert rows_of(rollup.projected(g.targeted, g.chains, at).select(columns)) == rows_of(want.select(columns))
    seen = lambda chain: hierarchy.first_in(chain, lambda x: (x["dist"] > 0) & ~x["level"].eqNullSafe(0), farthest=True)
    want = rollup.anchored(g.edges, rollup.visible_anchors(closure, nodes, nodes.where("level = 0")), "edge_type")
    assert rows_of(rollup.projected(g.targeted, g.chains, seen, "edge_type").select("edge_type", *columns)) == rows_of(want.select("edge_type", *columns))


#: What a query may write: keys and chains alone, not the graph's tables, its closure or its pairs.
KEYS, EDGES = {"chains", "items"}, {"chains", "items", "produced", "following", "targeted"}
STORED = {"closure_depth_hist": KEYS, "anchor_at_granularity": KEYS, "descendants": KEYS, "ordered_ancestors": KEYS, "rollup_all": EDGES, "rollup_between": EDGES, "rollup_by_level": EDGES, "rollup_add_delta": EDGES, "rollup_delete_delta": EDGES, "pair_expanded": EDGES, "hop_by_type": EDGES, "expand_pair": EDGES, "has_lineage_at_level": EDGES, "project_granularity": EDGES, "projected_bundles": EDGES}


@pytest.mark.parametrize("name", sorted(STORED))
def test_what_is_stored(spark, sf_dir, monkeypatch, name):
    seen, real = set(), catalogue.stored
    monkeypatch.setattr(catalogue, "_kept", {})
    monkeypatch.setattr(catalogue, "stored", lambda df, name, *by: seen.add(name) or real(df, name, *by))
    assert catalogue.queries()[name](spark, sf_dir).limit(1).count() == 1
    assert seen <= STORED[name]


def test_nearest_with_lineage(spark, odd):
    from tracewell.operators import traversal

    g, _, closure = both(spark, odd)
    some = g.edges.where("edge_type = 'DERIVED_FROM'")
    assert rows_of(traversal.with_lineage_in(some, g.ups)) == rows_of(traversal.with_lineage_or_ancestor(some, closure, g.nodes))
