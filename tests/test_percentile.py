"""The exact percentile against sorted lists: hot groups and values, ties, nulls, no rows."""

import random

import pytest

from tracewell.operators import catalog


@pytest.mark.parametrize("p", [0, 50, 95, 100])
def test_nearest_rank(spark, p):
    rng = random.Random(7)
    rows = [("hot", float(rng.randrange(400))) for _ in range(3000)] + [("hot", 5.0)] * 2000 + [("one", 1.5), (None, 2.0), (None, 3.0), ("few", -1.0), ("few", None), ("few", 4.0), ("none", None)]
    got = {r.g: r.value for r in catalog.nearest_rank(spark.createDataFrame(rows, "g string, x double"), "g", "x", p).collect()}
    groups = {}
    for g, x in rows:
        if x is not None:
            groups.setdefault(g, []).append(x)
    assert got == {g: sorted(v)[min(int(len(v) * p / 100), len(v) - 1)] for g, v in groups.items()}


def test_no_rows(spark):
    assert catalog.nearest_rank(spark.createDataFrame([], "g string, x double"), "g", "x", 95).collect() == []
