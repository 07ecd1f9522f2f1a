"""Every query of the catalogue against its SQL twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tracewell.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return out


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: round(x, 6) if isinstance(x, float) and math.isfinite(x) else x
    return sorted([tuple(value(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    rows = df.collect()
    if name not in catalogue.SQL:
        assert rows
        return
    rel = con.execute(catalogue.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(rel.fetchall(), names)
