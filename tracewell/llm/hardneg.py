"""Hard negatives by vantage-point trees over norm-augmented vectors.

One more coordinate, sqrt(M^2 - |v|^2), puts all vectors of a tree at the same distance M from the origin; an
anchor gets 0 there. Then distance^2 = |anchor|^2 + M^2 - 2 * score: the best score is the nearest vector, and a
window of scores is an annulus around the anchor. The rows of a scan partition form blocks of BLOCK rows,
and a block is a tree: an inner node has a vantage point and the range of distances from it to either half.
By the triangle inequality these give, for an anchor and a leaf, the nearest and the farthest that a row of it
can be.

A search visits leaves nearest first, skips those outside the annulus, and stops once it has k rows that no
unvisited leaf can beat. It runs twice: for the k nearest rows of the anchor's label (its positives), and
in the annulus of each of them for rows of other labels. A leaf's scores are worked out for a whole block
of anchors at once, when the first of them asks. Scores are whole numbers and exact; bounds leave
room for rounding, so pruning loses nothing.

Blocks are dealt evenly to groups, every block of anchors goes to every group, and an equality join on the
group brings each pair together once. Per anchor and block k rows are left, of which a rank keeps k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import EXACT, materialise, packed, quantised, quoted, small_batches, unpacked

SCALE = 256
#: Rows of a tree and, at most, of a leaf.
BLOCK, LEAF = 8192, 256
#: Anchors in a block of them.
ANCHORS = 256
#: Groups of blocks for each shuffle partition.
GROUPS = 4
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these shares (in hundredths) of the positive's.
LOW, HIGH = 30, 90


def whole(values: list[list[float]]) -> np.ndarray:
    return quantised(values, SCALE)


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products [anchor, row], exact: doubles if that suffices, else Python integers."""
    if rows.dtype != object and anchors.dtype != object and rows.shape[1] * np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) < EXACT:
        return anchors @ rows.T
    exact = [[int(x) for x in r] for r in rows], [[int(x) for x in a] for a in anchors]
    out = np.empty((len(anchors), len(rows)), object)
    for i, a in enumerate(exact[1]):
        out[i] = [sum(x * y for x, y in zip(a, r, strict=True)) for r in exact[0]]
    return out


@dataclass
class Tree:
    """Leaves are runs of rows: leaf j has rows cuts[j] to cuts[j + 1]. Inner nodes are in heap order."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    vantage: np.ndarray  # row numbers
    near: np.ndarray  # [inner node, 2]: least and largest distance of the left half
    far: np.ndarray
    cuts: np.ndarray


def augmented(rows: np.ndarray) -> tuple[np.ndarray, float]:
    """Doubles with the coordinate that evens out norms, and M^2."""
    v = rows.astype(float)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = (v * v).sum(1)
        most = float(norms.max(initial=0))
        return np.column_stack([v, np.sqrt(np.maximum(most - norms, 0))]), most


def build(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> Tree:
    """Halves by distance from a vantage point, down to leaves of LEAF rows; a child's vantage point is the
    row farthest from its parent's. Equal rows are halved like others."""
    n = len(rows)
    depth = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    inner = (1 << depth) - 1
    full, _ = augmented(rows)
    order, spans, points = np.arange(n), [(0, n)], [0]
    near, far, vantage = np.zeros((inner, 2)), np.zeros((inner, 2)), np.zeros(inner, np.int64)
    for i in range(inner):
        (a, b), point = spans[i], points[i]
        with np.errstate(over="ignore", invalid="ignore"):
            d = np.sqrt(((full[order[a:b]] - full[point]) ** 2).sum(1))
        by = np.argsort(d, kind="stable")
        order[a:b], d, mid = order[a:b][by], d[by], (b - a) // 2
        near[i], far[i], vantage[i] = (d[0], d[mid - 1]), (d[mid], d[-1]), point
        spans += [(a, a + mid), (a + mid, b)]
        points += [int(order[b - 1])] * 2
    leaves = spans[inner:]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return Tree(ids[order], labels[order], rows[order], place[vantage], near, far, np.array([leaves[0][0], *[b for _, b in leaves]]))


def reachable(tree: Tree, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score [anchor, leaf] that a row of the leaf can have."""
    q = anchors.astype(float)
    with np.errstate(over="ignore", invalid="ignore"):
        norms, (full, most) = (q * q).sum(1), augmented(tree.rows)
        to = np.sqrt(np.maximum(norms[:, None] + most - 2 * (q @ full[tree.vantage, :-1].T), 0))
        least, largest = np.zeros((len(q), 1)), np.full((len(q), 1), np.inf)
        at = 0
        while at < len(tree.vantage):  # a level of the tree at a time
            level = np.arange(at, 2 * at + 1)
            d, sides = to[:, level], []
            for half in (tree.near[level], tree.far[level]):
                sides.append((np.maximum(least, np.maximum(d - half[:, 1], half[:, 0] - d)), np.minimum(largest, d + half[:, 1])))
            least, largest = (np.stack([s[k] for s in sides], 2).reshape(len(q), -1) for k in (0, 1))
            at = 2 * at + 1
        middle, slack = (norms + most)[:, None], 1e-9 * (norms + most)[:, None] + 1
        low, high = (middle - largest**2) / 2 - slack, (middle - least**2) / 2 + slack
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


class Search:
    """A block of anchors in a tree."""

    def __init__(self, tree: Tree, anchors: np.ndarray):
        self.tree, self.anchors = tree, anchors
        self.low, self.high = reachable(tree, anchors)
        self.leaf_of = np.repeat(np.arange(len(tree.cuts) - 1), np.diff(tree.cuts))
        self.known = np.zeros(len(tree.cuts) - 1, bool)
        self.scores: np.ndarray | None = None
        self.visited = 0

    def score(self, leaves: np.ndarray) -> None:
        for j in leaves[~self.known[leaves]]:
            a, b = self.tree.cuts[j : j + 2]
            s = scores(self.tree.rows[a:b], self.anchors)
            if self.scores is None:
                self.scores = np.zeros((len(self.anchors), len(self.tree.rows)), s.dtype)
            elif s.dtype == object:
                self.scores = self.scores.astype(object)
            self.scores[:, a:b] = s
            self.known[j] = True

    def nearest(self, q: int, may: np.ndarray, windows: list[tuple], k: int) -> list[list[tuple[int, int]]]:
        """For each window (low, high) of scores the first k (score, id) by falling score, then id, of the rows that may."""
        order = np.argsort(-self.high[q], kind="stable")
        found: list[list[tuple]] = [[] for _ in windows]
        at, step = 0, 1
        while at < len(order):
            best = self.high[q, order[at]]
            least = [max(w[0], f[k - 1][0]) if len(f) == k else w[0] for w, f in zip(windows, found, strict=True)]
            wanted = [i for i, x in enumerate(least) if x <= best]
            if not wanted:
                break
            floor, top = min(least[i] for i in wanted), max(windows[i][1] for i in wanted)
            leaves = order[at : at + step]
            at, step = at + step, 2 * step
            leaves = leaves[(self.high[q, leaves] >= floor) & (self.low[q, leaves] <= top)]
            if not len(leaves):
                continue
            self.visited += len(leaves)
            self.score(leaves)
            asked = np.zeros(len(self.known), bool)
            asked[leaves] = True
            s = self.scores[q]
            rows = np.flatnonzero(may & asked[self.leaf_of] & (s >= floor) & (s <= top))
            rows = rows[np.lexsort((self.tree.ids[rows], -s[rows]))] if s.dtype != object else np.array(sorted(rows, key=lambda r: (-s[r], self.tree.ids[r])), np.int64)
            falling = s[rows]
            for i in wanted:
                first = int(np.searchsorted(-falling, -windows[i][1]))
                new = [(int(x), int(self.tree.ids[r])) for x, r in zip(falling[first : first + k], rows[first : first + k], strict=True) if x >= windows[i][0]]
                found[i] = sorted(found[i] + new, key=lambda x: (-x[0], x[1]))[:k]
        return found


def usable(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label, v (doubles) of the rows that take part."""
    v = F.transform(quoted(embedding), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    there = quoted(vec_id).isNotNull() & quoted(embedding).isNotNull() & quoted(label).isNotNull()
    return df.where(there).where(finite).select(quoted(vec_id).cast("long").alias("vec_id"), quoted(label).cast("long").alias("label"), v.alias("v"))


def runs(batches, most: int) -> Iterator[list[dict]]:
    """Runs of at most so many rows, each of vectors with one number of dimensions."""
    held: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            same = held.setdefault(len(row["v"]), [])
            same.append(row)
            if len(same) == most:
                yield held.pop(len(row["v"]))
    yield from held.values()


def numbers(kind: str, data: bytes, dims: int, n: int) -> np.ndarray:
    """Doubles, or Python integers where those are not exact."""
    x = unpacked(kind, data, n, dims)
    return x if x.dtype == object else x.astype(float) if np.abs(x).max(initial=0) < EXACT else x.astype(object)


TREES = "part int, seq int, dims int, kind string, ids binary, labels binary, rows binary, vantage binary, near binary, far binary, cuts binary"
SENT = "dims int, kind string, ids binary, labels binary, rows binary, windows array<array<struct<positive:int,low:long,high:long>>>"
HITS = "anchor_id long, positive int, vec_id long, score long"


def index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """The trees, made within scan partitions without a shuffle, as a table."""
    small_batches(vectors.sparkSession)

    def make(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, rows in enumerate(runs(batches, BLOCK)):
            t = build(np.array([r["vec_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), whole([r["v"] for r in rows]))
            kind, data = packed(t.rows)
            row = {"part": part, "seq": seq, "dims": t.rows.shape[1], "kind": kind, "rows": data} | {c: getattr(t, c).tobytes() for c in ("ids", "labels", "vantage", "near", "far", "cuts")}
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    types = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(name, types[kind]) for name, kind in map(str.split, TREES.split(", "))])
    return materialise(usable(vectors, vec_id, embedding, label).mapInArrow(make, TREES), "vantage_trees")


def tree_of(row: dict) -> Tree:
    ids = np.frombuffer(row["ids"], np.int64)
    return Tree(ids, np.frombuffer(row["labels"], np.int64), numbers(row["kind"], row["rows"], row["dims"], len(ids)), np.frombuffer(row["vantage"], np.int64), np.frombuffer(row["near"]).reshape(-1, 2), np.frombuffer(row["far"]).reshape(-1, 2), np.frombuffer(row["cuts"], np.int64))


def sent(anchors: DataFrame) -> DataFrame:
    """Blocks of anchors (vec_id, label, v, windows) as a table."""

    def make(batches):
        for rows in runs(batches, ANCHORS):
            x = whole([r["v"] for r in rows])
            kind, data = packed(x)
            one = {"dims": x.shape[1], "kind": kind, "ids": np.array([r["vec_id"] for r in rows], np.int64).tobytes(), "labels": np.array([r["label"] for r in rows], np.int64).tobytes(), "rows": data, "windows": [r["windows"] for r in rows]}
            yield pa.RecordBatch.from_pylist([one], schema=arrow)

    window = pa.list_(pa.list_(pa.struct([("positive", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])))
    arrow = pa.schema([("dims", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()), ("rows", pa.binary()), ("windows", window)])
    return materialise(anchors.mapInArrow(make, SENT), "anchor_blocks")


def searched(trees: DataFrame, blocks: DataFrame, groups: int, same_label: bool, k: int) -> DataFrame:
    """anchor_id, positive, vec_id, score, rank: the first k rows of the anchor's label (windows aside), or the first
    k of others in each window."""
    near = trees.withColumn("group", F.pmod(F.col("part") + F.col("seq"), F.lit(groups)))
    to = blocks.select("dims", F.col("kind").alias("a_kind"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("rows").alias("a_rows"), "windows", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))

    def find(batches):
        for batch in batches:
            for row in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                ids = np.frombuffer(row["a_ids"], np.int64)
                labels = np.frombuffer(row["a_labels"], np.int64)
                tree = tree_of(row)
                search = Search(tree, numbers(row["a_kind"], row["a_rows"], row["dims"], len(ids)))
                out = []
                for q, (own, label, windows) in enumerate(zip(ids, labels, row["windows"], strict=True)):
                    may = (tree.labels == label) == same_label
                    if same_label:
                        may &= tree.ids != own
                    asked = [(0, -math.inf, math.inf)] if same_label else [(w["positive"], w["low"], w["high"]) for w in windows]
                    for w, rows in zip(asked, search.nearest(q, may, [w[1:] for w in asked], k), strict=True):
                        out += [(own, w[0], i, s) for s, i in rows]
                if any(not -(1 << 63) <= x[3] < 1 << 63 for x in out):
                    raise ValueError("a score does not fit a long")
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["anchor_id", "positive", "vec_id", "score"])

    hits = near.join(to, ["group", "dims"]).mapInArrow(find, HITS)
    order = Window.partitionBy("anchor_id", "positive").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(256 * x); higher ones come first, ties by the smaller vec_id. For each
    anchor and each of its first `positives` other rows of the same label (all, if fewer): the first
    `negatives` rows (all, if fewer) of other labels with 30 * positive_score <= 100 * score <= 90 * positive_score.
    For a negative positive_score no number meets that; for zero only zero does.

    Null ids, labels and vectors, and vectors with a null or non-finite component, take no part; vectors meet those
    of as many dimensions. Rows that repeat a vec_id count once each as positives and negatives, but never
    as positives of their own id; anchors that repeat an id are one anchor, with the smallest (label,
    vector). Components of any size are exact; a score that is part of a result and fits no long ends the query.
    Empty tables: no rows."""
    trees = index(vectors, vec_id, embedding, label)
    groups = max(1, min(trees.count(), GROUPS * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    once = usable(anchors, vec_id, embedding, label).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")
    once = materialise(once, "anchors")
    none = F.array().cast("array<struct<positive:int,low:long,high:long>>")
    own = searched(trees, sent(once.withColumn("windows", none)), groups, True, positives)
    own = materialise(own.select("anchor_id", F.col("rank").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    s = F.col("positive_score").cast("decimal(38,0)")
    low, high = F.ceil(s * LOW / 100).cast("long"), F.floor(s * HIGH / 100).cast("long")
    windows = own.where(low <= high).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("positive", low.alias("low"), high.alias("high")))).alias("windows"))
    others = searched(trees, sent(once.join(windows, "vec_id").select("vec_id", "label", "v", "windows")), groups, False, negatives)
    return others.join(own, ["anchor_id", "positive"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
