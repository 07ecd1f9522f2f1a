"""Hard negatives against SQL and brute force; trees against all rows."""

import math

import duckdb
import numpy as np
import pytest

from tracewell.llm import hardneg, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, anchors, positives=5, negatives=10):
    """Over (id, vector, label) of rows that take part."""
    ints = [(i, [math.floor(x * 256) if abs(x) < 2**53 else int(x) * 256 for x in v], c) for i, v, c in rows]
    out = []
    for a, v, label in ints:
        if a in anchors:
            score = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, c) for i, w, c in ints if len(w) == len(v)]
            for p, i, _ in sorted(x for x in score if x[2] == label and x[1] != a)[:positives]:
                fit = sorted(x for x in score if x[2] != label and -30 * p <= -100 * x[0] <= -90 * p)
                out += [(a, i, r, n[1], -p, -n[0]) for r, n in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(df, by=1, **k):
    return sorted(tuple(r) for r in hardneg.mine(df, df.where(f"vec_id % {by} = 0"), **k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    rel = con.execute(queries.OP11_SQL)
    want = sorted(rel.fetchall())
    got = queries.op11_hard_negatives(spark, sf_dir).select(*[d[0] for d in rel.description]).collect()
    assert want and sorted(map(tuple, got)) == want


def test_ties_labels_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist(), i % 3) for i in range(120)]
    odd = [(200, None, 1), (201, [1.0, None, 0.0], 1), (202, [math.nan, 0.0, 0.0], 1), (203, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (204, [1.0, 1.0], 1), (208, [1.0, 0.8], 2), (212, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    good = rows + odd[5:]
    got = mined(df, 4)
    assert got == brute(good, {i for i, _, _ in good if i % 4 == 0}) and any(x[0] == 204 for x in got)


def test_large_components_are_exact(spark):
    """Scores beyond what a double holds; one that a result needs and fits no long ends the query."""
    rows = [(0, [2.0e6, 3.0], 0), (1, [2.0e6, 5.0], 0), (2, [1.0e6, 7.0], 1), (3, [1.0e6, 7.5], 1), (4, [1.5e6, -1.0], 1), (5, [1e300, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert mined(df, 10) == brute(rows, {0}) and any(x[4] > 1 << 53 for x in mined(df, 10))
    with pytest.raises(Exception, match="fit a long"):
        mined(spark.createDataFrame([(0, [1e12], 0), (1, [1e12], 0)], SCHEMA), 10)


def test_repeated_ids(spark):
    """A repeated id counts once for each row, and is no positive of its own."""
    rows = [(0, [1.0], 0), (0, [1.0], 0), (1, [1.0], 0), (2, [0.5], 1), (2, [0.5], 1)]
    got = mined(spark.createDataFrame(rows, SCHEMA), 10)
    assert [(x[1], x[2], x[3]) for x in got] == [(1, 1, 2), (1, 2, 2)]


def test_empty_and_one_label(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(5)], SCHEMA)
    assert mined(df) == [] and mined(df.limit(0)) == []


def test_tree_prunes_and_loses_nothing():
    """Clusters: a search visits a part of the leaves and finds what all rows would give."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 6))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = hardneg.whole((centres[rng.integers(0, 40, 8000)] + rng.normal(scale=0.02, size=(8000, 6))).tolist())
    tree = hardneg.build(np.arange(8000), rng.integers(0, 3, 8000), rows)
    asked = tree.rows[rng.integers(0, 8000, 20)]
    search = hardneg.Search(tree, asked)
    every = hardneg.scores(tree.rows, asked)
    assert ((every >= search.low[:, search.leaf_of]) & (every <= search.high[:, search.leaf_of])).all()
    for q in range(20):
        may, top = tree.labels != 1, int(every[q].max())
        windows = [(-math.inf, math.inf), (math.ceil(top * 0.3), math.floor(top * 0.9)), (top + 1, math.inf)]
        got = search.nearest(q, may, windows, 10)
        for w, found in zip(windows, got, strict=True):
            want = sorted((-int(s), int(i)) for s, i, m in zip(every[q], tree.ids, may, strict=True) if m and w[0] <= s <= w[1])[:10]
            assert found == [(-s, i) for s, i in want]
    fresh = hardneg.Search(tree, asked)
    for q in range(20):
        fresh.nearest(q, tree.labels != 1, [(-math.inf, math.inf)], 10)
    assert fresh.visited < 20 * len(fresh.known) / 2


def test_tree_of_equal_rows():
    tree = hardneg.build(np.arange(2000), np.zeros(2000, np.int64), np.ones((2000, 4)))
    found = hardneg.Search(tree, np.ones((1, 4))).nearest(0, np.ones(2000, bool), [(-math.inf, math.inf)], 5)
    assert np.diff(tree.cuts).max() <= hardneg.LEAF and [i for _, i in found[0]] == [0, 1, 2, 3, 4]
