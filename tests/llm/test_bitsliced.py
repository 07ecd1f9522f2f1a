"""Exact top-k against brute force, on random integers, ties and odd vectors."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import bitsliced, queries

VECTORS = "vec_id long, embedding array<float>"


def simple_top(rows, asked, k):
    v = {i: [int(np.floor(np.float64(np.float32(x)) * 1024)) for x in e] for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in asked:
        if q in v:
            s = sorted((-sum(a * b for a, b in zip(v[q], c, strict=True)), i) for i, c in v.items() if i != q and len(c) == len(v[q]))[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_small_tables(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    got = sorted(tuple(r) for r in queries.op4_top_k(spark, sf_dir).collect())
    assert got == simple_top(rows, [i for i, _ in rows if i % 100 == 0], 10)
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.OP4_SQL})").fetchall()
    assert got == sorted(want)


@pytest.mark.parametrize("block", [3, 64, 8192])
def test_ties_and_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(bitsliced, "BLOCK", block)
    monkeypatch.setattr(bitsliced, "QUERIES", 2)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(150)]
    rows += [(i, [1.0, -1.0, 0.5, 0.0]) for i in range(200, 260)] + [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf"), 0.0, 0.0, 0.0]), (304, [2.0]), (400, [1e-9, -1e-9, 0.1, 3.0]), (500, [0.0] * 4)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("own")).withColumn("group", F.lit(1)).repartition(3)
    asked = [0, 200, 300, 304, 400, 500]
    for k in (1, 10, 1000):
        got = bitsliced.top_k(df, df.where(F.col("vec_id").isin(asked)), k)
        assert sorted(tuple(r) for r in got.collect()) == simple_top(rows, asked, k)


def test_repeats_nulls_and_no_rows(spark):
    rows = [(1, [1.0]), (1, [1.0]), (2, [2.0]), (2, [2.0]), (None, [5.0])]
    df = spark.createDataFrame(rows, VECTORS)
    got = bitsliced.top_k(df, df.where("vec_id = 1 or vec_id is null"), 5)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(1, 1, 2, 2 * 1024 * 1024), (1, 2, 2, 2 * 1024 * 1024)]
    assert bitsliced.top_k(df.limit(0), df, 5).count() == bitsliced.top_k(df, df.limit(0), 5).count() == 0


def test_large_components_are_exact(spark):
    """Scores beyond what 63 bits of planes hold, up to the edge of a long; also components that are no long at all."""
    rows = [(0, [2.0e6, 2.0e6, 1.0, 0.0]), (1, [1.0e6, 5.0e5, 3.0, 0.0]), (2, [-2.0e6, -1.0e6, 0.0, 0.0]), (3, [0.0, 0.0, 7.0, 1e300]), (4, [0.0, 2.1e6, 0.0, -1e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: [int(x) * 1024 for x in v] for i, v in rows}
    for q in (0, 1):
        want = sorted((-sum(a * b for a, b in zip(exact[q], c, strict=True)), i) for i, c in exact.items() if i != q)
        assert all(abs(s) < 1 << 63 for s, _ in want)
        got = bitsliced.top_k(df, df.where(F.col("vec_id") == q), 10).orderBy("rank").collect()
        assert [(-r.score, r.vec_id) for r in got] == want


def test_score_that_fits_no_long(spark):
    """It ends the query where it belongs to the result, and only there."""
    rows = [(0, [2.0e6] * 4), (1, [1.0] * 4), (2, [-2.0e6] * 4), (3, [2.0e6] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        bitsliced.top_k(df, df.where("vec_id = 0"), 1).collect()
    few = df.where("vec_id <> 3")
    assert [tuple(r) for r in bitsliced.top_k(few, few.where("vec_id = 0"), 1).collect()] == [(0, 1, 1, 4 * 1024 * 1024 * 2_000_000)]
