"""Embedding whitening with covariances merged by Chan's formula.

A component c counts as the whole number floor(64 * c) + 1000000, whose mean is large against its spread:
sums of squares would lose the covariance in rounding. Each task reads its rows in Arrow batches and keeps
count, sums (exact), and the scatter around its own mean; two such states merge by

    scatter = scatter_a + scatter_b + (n_a * n_b / n) * outer(mean_b - mean_a)

in a treeReduce, so that no more than a few states of dims x dims meet on the driver at once, whatever the
number of rows. The driver takes eigenvectors of that one matrix. A second pass over the rows whitens them
and merges the covariance of what comes out in the same way; it has to be the identity.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, LongType, StructField

from tracewell.llm.common import append_arrow, fresh, quoted, small_batches

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: An eigenvalue below this share of the largest one is rounding: the vectors don't extend that way.
RANK = 1e-12
#: Whole numbers of a double.
EXACT = 1 << 53


@dataclass(frozen=True)
class State:
    """Vectors seen: how many, their sums (Python integers for whole numbers, else floats), and the scatter
    around their mean."""

    n: int
    sums: tuple
    scatter: np.ndarray


@dataclass(frozen=True)
class Model:
    """Of the vectors with one number of dimensions."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # [component, dimension]
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean is taken off exactly."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        return (x - np.array(whole, np.int64)).astype(float) - rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int] | np.ndarray:
        """Sum over dimensions of (n * x - S)^2, exact."""
        far = max((abs(int(x[:, j].max(initial=0)) * self.n - s) + abs(int(x[:, j].min(initial=0)) * self.n - s) for j, s in enumerate(self.sums)), default=0)
        if far * far * max(1, len(self.sums)) < 1 << 63 and max(map(abs, self.sums), default=0) < 1 << 62:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(1)
        return [sum((int(v) * self.n - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]


def chan(a: State, b: State) -> State:
    """The state of both; the difference of means is taken from exact sums."""
    if not a.n or not b.n:
        return a if a.n else b
    gap = np.array([(y * a.n - x * b.n) / (a.n * b.n) for x, y in zip(a.sums, b.sums, strict=True)])
    n = a.n + b.n
    return State(n, tuple(x + y for x, y in zip(a.sums, b.sums, strict=True)), a.scatter + b.scatter + np.outer(gap, gap) * (a.n / n * b.n))


def both(a: dict[int, State], b: dict[int, State]) -> dict[int, State]:
    """States by number of dimensions."""
    return {d: chan(a[d], b[d]) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}


def state_of(x: np.ndarray) -> State:
    """Of whole numbers [rows, dims] (as int64)."""
    pivot = x[0]
    off = x - pivot  # small where the offset is common to all
    sums = [int(s) for s in off.sum(0)] if int(np.abs(off).max(initial=0)) * len(x) < 1 << 62 else [sum(map(int, off[:, j])) for j in range(x.shape[1])]
    centred = off.astype(float) - np.array([s / len(x) for s in sums])
    return State(len(x), tuple(s + int(p) * len(x) for s, p in zip(sums, pivot, strict=True)), centred.T @ centred)


def by_dims(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, doubles [rows, dims]) of a list column without nulls, for each number of dimensions but none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def whole(c: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1000000 as int64."""
    x = np.floor(c * SCALE)
    if np.abs(x).max(initial=0) >= EXACT - OFFSET:
        raise ValueError("a component is too large: 64 times it is no whole number that a double holds")
    return x.astype(np.int64) + OFFSET


def usable(df: DataFrame, embedding: str) -> DataFrame:
    """Rows whose vector is there and holds no null and nothing non-finite; it becomes doubles."""
    v = F.transform(quoted(embedding), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(quoted(embedding).isNotNull()).where(finite).withColumn(embedding, v)


def _states(rows: DataFrame, make) -> dict[int, State]:
    """Merged states of make(doubles) over a column `v`."""

    def partial(batches):
        held: dict[int, State] = {}
        for batch in batches:
            for _, c in by_dims(batch.column(0)):
                held = both(held, make(c))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["state"])

    small_batches(rows.sparkSession)
    states = rows.mapInArrow(partial, "state binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return states.treeAggregate({}, both, both, depth=3)


def fit(df: DataFrame, embedding: str = "embedding", components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each number of dimensions that vectors have (vectors of other sizes have no covariance
    with them). Vectors that are null, or hold null or non-finite entries, take no part; repeated
    rows count each. Components along which the vectors don't extend (eigenvalue zero but for rounding) can't
    be scaled and are left out; there are at most `components`. No rows: no model."""
    rows = usable(df.select(quoted(embedding).alias("v")), "v")
    out = {}
    for d, s in _states(rows, lambda c: {c.shape[1]: state_of(whole(c))}).items():
        e, vectors = np.linalg.eigh(s.scatter / s.n)
        e, vectors = e[::-1], vectors.T[::-1]
        used = int((e[:components] > max(RANK * e[0], 0)).sum())
        out[d] = Model(s.n, s.sums, e[:used].copy(), np.ascontiguousarray(vectors[:used]), float(np.trace(s.scatter) / s.n))
    return out


def identity_error(df: DataFrame, models: dict[int, Model], embedding: str = "embedding") -> float:
    """The second pass: the largest absolute entry of (covariance of the whitened rows - identity), over all models."""

    def make(c: np.ndarray) -> dict[int, State]:
        w = models[c.shape[1]].whiten(whole(c))
        centred = w - w.mean(0)
        return {c.shape[1]: State(len(w), tuple(w.sum(0).tolist()), centred.T @ centred)}

    found = _states(usable(df.select(quoted(embedding).alias("v")), "v"), make)
    return max((float(np.abs(s.scatter / s.n - np.eye(len(s.scatter))).max(initial=0)) for s in found.values()), default=0.0)


def whiten(df: DataFrame, models: dict[int, Model], embedding: str = "embedding", prefix: str = "") -> DataFrame:
    """df's usable rows with <prefix>n, <prefix>deviation (exact, decimal), <prefix>whitened and
    <prefix>explained (arrays, one entry for each component). Columns of those names give way; all
    others pass through."""
    fields = [StructField(f"{prefix}n", LongType()), StructField(f"{prefix}deviation", DecimalType(38, 0)), StructField(f"{prefix}whitened", ArrayType(DoubleType())), StructField(f"{prefix}explained", ArrayType(DoubleType()))]
    own = fresh(df, "vector_as_doubles")
    rows = usable(df.withColumn(own, quoted(embedding)), own)

    def start():
        def make(batch: pa.RecordBatch) -> list[pa.Array]:
            size = batch.num_rows
            n, deviation, whitened, explained = [0] * size, [0] * size, [[]] * size, [[]] * size
            for at, c in by_dims(batch.column(own)):
                m, x = models[c.shape[1]], whole(c)
                w, far, share = m.whiten(x), m.deviation(x), (m.values / m.trace).tolist() if m.trace else []
                for i, r in enumerate(at):
                    n[r], deviation[r], whitened[r], explained[r] = m.n, int(far[i]), w[i].tolist(), share
            return [pa.array(n, pa.int64()), _decimals(deviation), pa.array(whitened, pa.list_(pa.float64())), pa.array(explained, pa.list_(pa.float64()))]

        return make

    out = append_arrow(rows, fields, start, sized=own)
    return out.drop(own)


def _decimals(values: list[int]) -> pa.Array:
    if max(values, default=0) < 1 << 63:
        return pa.array(values, pa.int64()).cast(pa.decimal128(38, 0))
    from decimal import Decimal

    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))
