"""Whitening against plain numpy over all rows at once."""

import math

import numpy as np
import pytest

from tracewell.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n string"


def plain(vectors):
    x = np.floor(np.array(vectors, float) * 64) + 1_000_000
    v = np.cov(x.T, bias=True).reshape(x.shape[1], -1)
    e, u = np.linalg.eigh(v)
    return x, e[::-1], u[:, ::-1], np.trace(v)


def test_query_against_numpy(spark, sf_dir):
    rows = queries.op13_whiten(spark, sf_dir).toPandas()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x, e, u, trace = plain(table["embedding"].tolist())
    assert len(rows) == 32 * len(table) and (rows["n"] == len(table)).all()
    w = (x - x.mean(0)) @ u[:, :32] / np.sqrt(e[:32])
    got = rows.pivot(index="vec_id", columns="component", values="whitened").loc[table["vec_id"]].to_numpy()
    assert np.allclose(np.abs(got), np.abs(w), atol=1e-6)
    assert np.abs(np.cov(got.T, bias=True) - np.eye(32)).max() < 1e-8
    assert rows["identity_error"].nunique() == 1 and rows["identity_error"].iloc[0] < 1e-8
    first = rows.groupby("component")["explained"].first()
    assert np.allclose(first, e[:32] / trace, rtol=1e-9)
    sums, n = [int(s) for s in x.sum(0)], len(x)
    exact = dict(zip(table["vec_id"], [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x], strict=True))
    assert rows.drop_duplicates("vec_id").set_index("vec_id")["deviation"].to_dict() == exact


def test_chan_merges_in_any_order():
    x = np.random.default_rng(1).integers(1_000_000, 1_000_050, (97, 5))
    whole = whitening.state_of(x)
    for cuts in ([10, 11, 60], [1, 2, 3], [96]):
        parts = [whitening.state_of(p) for p in np.split(x, cuts)]
        for order in (parts, parts[::-1]):
            held = order[0]
            for p in order[1:]:
                held = whitening.chan(held, p)
            assert held.n == whole.n and held.sums == whole.sums
            assert np.allclose(held.scatter, whole.scatter, rtol=1e-12)


def test_odd_rows_take_no_part(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=4).tolist(), "x") for i in range(50)]
    odd = [(90, None, "a"), (91, [1.0, None, 0.0, 0.0], "a"), (92, [math.nan, 0.0, 0.0, 0.0], "a"), (93, [math.inf, 0.0, 0.0, 0.0], None), (94, [], None)]
    df = spark.createDataFrame(good + odd, SCHEMA)
    models = whitening.fit(df)
    assert list(models) == [4] and models[4].n == 50
    out = whitening.whiten(df, models, prefix="w_").collect()
    assert {r["vec_id"] for r in out} == {*range(50), 94} and all(r["n"] == "x" for r in out if r["vec_id"] < 50)
    assert all(len(r["w_whitened"]) == 4 for r in out if r["vec_id"] < 50)


def test_repeated_flat_and_mixed_rows(spark):
    """Repeated rows count each; directions without spread are left out; each size has its own model."""
    rows = [(1, [1.0, 5.0], ""), (1, [1.0, 5.0], ""), (2, [3.0, 5.0], ""), (3, [2.0, 2.0, 2.0], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    models = whitening.fit(df)
    assert {d: (m.n, len(m.values)) for d, m in models.items()} == {2: (3, 1), 3: (1, 0)}
    assert whitening.identity_error(df, models) < 1e-12
    got = {r["vec_id"]: r for r in whitening.whiten(df, models).collect()}
    assert got[3]["whitened"] == [] and got[3]["n"] == 1
    assert abs(abs(got[2]["whitened"][0]) - math.sqrt(2)) < 1e-9


def test_deviation_beyond_a_long(spark):
    """The operator's deviation is exact at any size; the query's long is null where it does not fit."""
    rows = [(i, [float(1 << 40) * (i % 2), 0.0], "") for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(df, whitening.fit(df)).collect()}
    x = [(1 << 46) * (i % 2) + 1_000_000 for i in range(4)]
    assert got == {i: (4 * x[i] - sum(x)) ** 2 for i in range(4)}
    with pytest.raises(Exception, match="too large"):
        whitening.fit(spark.createDataFrame([(1, [1e300], "")], "vec_id long, embedding array<double>, n string"))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    models = whitening.fit(df)
    assert models == {} and whitening.identity_error(df, models) == 0.0 and whitening.whiten(df, models).count() == 0
