"""Patterns, scopes and the forest's order on hand-made graphs."""

import fnmatch
import random

import pytest

from tracewell.operators import forest, hierarchy, scope


def test_patterns_against_plain_globs(spark):
    r = random.Random(2)
    piece = lambda: "".join(r.choice("aB.:[") for _ in range(r.randrange(4)))
    urns = sorted({"u:" + piece() + piece() for _ in range(60)})
    globs = sorted({r.choice(["u:", "U", ""]) + piece() + r.choice(["*", "?", "", "*x*", "?*"]) + piece() for _ in range(1000)})
    got = {(x.urn, x.pattern) for x in scope.matched(spark.createDataFrame([(u,) for u in urns], "urn string"), spark.createDataFrame([(g,) for g in globs], "pattern string")).collect()}
    fits = lambda u, g: fnmatch.fnmatchcase(u.lower(), g.lower().replace("[", "[[]"))
    assert got == {(u, g) for u in urns for g in globs if fits(u, g)} and got
    assert scope.matched(spark.createDataFrame([("u",)], "urn string"), spark.createDataFrame([], "pattern string")).isEmpty()


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("a", "T", ["x"]), ("b", "C", None), ("c", "C", ["y", "x"]), ("d", None, [])], "urn string, entity_type string, tags array<string>")
    closure = hierarchy.closure(spark.createDataFrame([("a", "b"), ("b", "c")], "parent_urn string, child_urn string"))
    return nodes, closure


@pytest.mark.parametrize(
    ("tree", "want"),
    [
        ({"all": []}, "abcd"),
        ({"any": []}, ""),
        ({"root_urns": ["b", "gone"]}, "bc"),
        ({"include_tags": ["y", "z"]}, "c"),
        ({"exclude_tags": ["x"]}, "bd"),
        ({"not": {"entity_types": ["C"]}}, "ad"),
        ({"all": [{"root_urns": ["a"]}, {"not": {"any": [{"urn_patterns": ["A"]}, {"urn_patterns": ["?c", "c*"]}]}}]}, "b"),
        (scope.compound(), "abcd"),
        (scope.compound(root_urns=["b"], entity_types=["T"]), "abc"),
        (scope.compound(root_urns=["b"], entity_types=["C"], include_tags=["x"], mode="and"), "c"),
        (scope.compound(root_urns=["a"], exclude_tags=["y"]), "ab"),
    ],
)
def test_scopes(graph, tree, want):
    out = scope.scoped(*graph, tree)
    assert out.columns == ["urn", "entity_type", "tags"] and sorted(r.urn for r in out.collect()) == list(want)


@pytest.mark.parametrize("tree", [{"some": []}, {"any": [], "all": []}])
def test_trees_that_mean_nothing(graph, tree):
    with pytest.raises(ValueError):
        scope.scoped(*graph, tree)


def test_order_of_a_forest_with_a_hot_parent(spark):
    """Against a plain walk; one parent has most of the nodes."""
    r = random.Random(4)
    parent = {f"n{i}": "n0" if r.random() < 0.8 else f"n{r.randrange(max(1, i - 5), i)}" for i in range(2, 120)}
    names = {u: r.choice("abc") for u in {*parent, "n0", "n1", "lone"}}
    kids, out = {}, {}
    for u in sorted(parent, key=lambda u: (names[u], u)):
        kids.setdefault(parent[u], []).append(u)

    def walk(u, depth):
        at = len(out)
        out[u] = None
        for k in kids.get(u, []):
            walk(k, depth + 1)
        out[u] = (parent.get(u), depth, at, len(out) - 1)

    for u in sorted(names.keys() - parent.keys(), key=lambda u: (names[u], u)):
        walk(u, 0)
    up = spark.createDataFrame(list(parent.items()), "urn string, parent_urn string")
    closure = hierarchy.closure(up.selectExpr("parent_urn", "urn AS child_urn"), 60)
    got = forest.intervals(spark.createDataFrame(list(names.items()), "urn string, display_name string"), up, closure)
    assert {x.urn: (x.parent_urn, x.depth, x.pre, x["last"]) for x in got.collect()} == out
    post = {x.urn: x.post for x in got.select("urn", forest.post_order().alias("post")).collect()}
    assert sorted(post.values()) == list(range(len(post))) and all(post[u] < post[p] for u, p in parent.items())
