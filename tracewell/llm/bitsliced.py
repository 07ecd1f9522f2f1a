"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to floor(scale * x). The rows of a scan partition form blocks of BLOCK rows in
vec_id order; slice j of an attribute is the bitmap of the block's rows that have bit j of
(value - lowest value of the block). A score is a weighted sum of attributes, so a query adds
slices: a set bit i of a weight puts slice j into column i + j, and a carry-save adder brings every
column down to one bitmap. Negative weights take complemented slices, which keeps all terms
positive; the constant they shift by is added at the end. The top rows of a block come from the most
significant slice downward: rows with the bit set stay ahead while they are fewer than k, otherwise
they become the new candidates. What is still tied below the last slice has equal scores, and the
smallest vec_ids of it fill up the k: the boundary is exact.

Blocks are dealt evenly to groups, a few for each shuffle partition; every query block goes to every
group, and an equality join on the group brings each block and query block together once. Per block
and query k rows are left; a rank over the query merges them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tracewell.llm.common import materialise, packed, quantised, unpacked

SCALE = 1024
BLOCK = 8192
#: Queries in a block of queries.
QUERIES = 256
#: Groups of blocks for each shuffle partition.
GROUPS = 4

BLOCKS = StructType([StructField("part", IntegerType()), StructField("seq", IntegerType()), StructField("dims", IntegerType()), StructField("bits", IntegerType()), StructField("ids", BinaryType()), StructField("kind", StringType()), StructField("low", BinaryType()), StructField("slices", BinaryType())])
QBLOCKS = StructType([StructField("dims", IntegerType()), StructField("ids", BinaryType()), StructField("q_kind", StringType()), StructField("weights", BinaryType())])
HITS = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", LongType()), StructField("over", BooleanType())])


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v (doubles) of rows whose id and components are all there and finite."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(finite)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as bitmaps of 64-bit words."""
    bits = np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, -bits.shape[-1] % 64)])
    return np.ascontiguousarray(np.packbits(bits, axis=-1, bitorder="little")).view(np.uint64)


def sliced(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """low [dims], slices [dims, bits, words] of whole values [rows, dims]."""
    low = values.min(0) if len(values) else np.zeros(values.shape[1], np.int64)
    above = (values - low).T
    bits = max(1, int(above.max(initial=0)).bit_length())
    planes = [pack(((above >> b) & 1).astype(bool)) for b in range(bits)]
    return low, np.ascontiguousarray(np.stack(planes, 1))


def add_up(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest bit of the sum of bitmaps [n, words], and the bitmaps that carry to the next column.

    Full adders work on thirds of the column at once: three bitmaps become one and a carry."""
    carries = []
    while len(column) > 1:
        n = len(column) // 3
        if n:
            a, b, c, rest = column[:n], column[n : 2 * n], column[2 * n : 3 * n], column[3 * n :]
            x = a ^ b
            carries.append((a & b) | (x & c))
            column = np.concatenate([x ^ c, rest])
        else:
            carries.append(column[:1] & column[1:])
            column = column[:1] ^ column[1:]
    return column[0], np.concatenate(carries) if carries else column[:0]


def scores(weights: np.ndarray, low: np.ndarray, slices: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Bitmaps of (score - shift), least significant first, and the shift."""
    dims, bits, words = slices.shape
    size, negative = np.abs(weights), weights < 0
    # w * u with w < 0 is |w| * (full - u) - |w| * full, and full - u is the complement of u's slices
    source = slices ^ np.where(negative, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))[:, None, None]
    shift = sum(int(w) * int(x) for w, x in zip(weights, low, strict=True)) - sum(map(int, size[negative])) * ((1 << bits) - 1)
    digits = [np.flatnonzero(((size >> i) & 1).astype(bool)) for i in range(int(size.max(initial=0)).bit_length())]
    planes, carried, i = [], np.zeros((0, words), np.uint64), 0
    while i < bits + len(digits) or len(carried):
        column = np.concatenate([carried, *[source[d, i - n] for n, d in enumerate(digits) if 0 <= i - n < bits]])
        if len(column):
            plane, carried = add_up(column)
        else:
            plane, carried = np.zeros(words, np.uint64), column
        planes.append(plane)
        i += 1
    return planes, shift


def ones(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(planes: list[np.ndarray], alive: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k largest (all, if fewer), ties to the smaller row number."""
    sure, maybe = np.zeros_like(alive), alive
    left = k
    for plane in reversed(planes):
        with_bit = maybe & plane
        n = int(np.bitwise_count(with_bit).sum())
        if n <= left:  # all of these are in; go on among the others for what is left
            sure = sure | with_bit
            left -= n
            maybe = maybe & ~plane
        else:
            maybe = with_bit
        if not left:
            break
    return np.sort(np.concatenate([ones(sure), ones(maybe)[:left]]))


def values_at(planes: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """The rows' numbers: int64 where they fit, else Python integers."""
    word, bit = rows // 64, (rows % 64).astype(np.uint64)
    wide = len(planes) > 62
    digit = lambda p: ((p[word] >> bit) & np.uint64(1)).astype(np.int64).astype(object if wide else np.int64)
    return sum((digit(p) * (1 << i) for i, p in enumerate(planes)), np.zeros(len(rows), object if wide else np.int64))


def block_top(weights: np.ndarray, query_id: int, ids: np.ndarray, low: np.ndarray, slices: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """vec_ids and scores (Python integers) of the block's k best rows for a query; ids rise."""
    planes, shift = scores(weights, low, slices)
    rows = top_rows(planes, pack((ids != query_id)[None])[0], k)
    return ids[rows], [int(x) + shift for x in values_at(planes, rows)]


def matrices(batches, most: int):
    """(ids, values) of at most so many rows with as many dimensions each."""
    held: dict[int, list] = {}
    for batch in batches:
        for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = held.setdefault(len(v), [])
            rows.append((vec_id, v))
            if len(rows) == most:
                yield held.pop(len(v))
    yield from held.values()


def as_arrays(rows: list) -> tuple[np.ndarray, np.ndarray]:
    rows.sort(key=lambda r: r[0])
    values = quantised([r[1] for r in rows], SCALE)
    return np.array([r[0] for r in rows], np.int64), values if values.dtype == object else values.astype(np.int64)


def index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The bit-sliced index: a row per block, made within scan partitions without a shuffle."""

    def build(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, rows in enumerate(matrices(batches, BLOCK)):
            ids, values = as_arrays(rows)
            low, slices = sliced(values)
            kind, data = packed(low)
            yield pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "dims": values.shape[1], "bits": slices.shape[1], "ids": ids.tobytes(), "kind": kind, "low": data, "slices": slices.tobytes()}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("dims", pa.int32()), ("bits", pa.int32()), ("ids", pa.binary()), ("kind", pa.string()), ("low", pa.binary()), ("slices", pa.binary())]))

    return materialise(usable(vectors, vec_id, embedding).mapInArrow(build, BLOCKS), "bit_slices")


def query_blocks(queries: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    def build(batches):
        for rows in matrices(batches, QUERIES):
            ids, values = as_arrays(rows)
            kind, data = packed(values)
            yield pa.RecordBatch.from_pylist([{"dims": values.shape[1], "ids": ids.tobytes(), "q_kind": kind, "weights": data}], schema=pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("q_kind", pa.string()), ("weights", pa.binary())]))

    once = usable(queries, vec_id, embedding).groupBy("vec_id").agg(F.min("v").alias("v"))
    return materialise(once.mapInArrow(build, QBLOCKS), "query_blocks")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest inner product for each query.

    All, if there are fewer; ties to the smaller vec_id; a query's own vec_id is no candidate.
    Null ids, null vectors and vectors with a null or non-finite component take no part; vectors
    meet only those of as many dimensions; empty vectors score 0. Rows that repeat a vec_id count
    once each as candidates; queries that repeat an id are one query, with the smallest vector. Components
    of any size are exact; a score of the result that fits no long ends the query. Empty tables: no rows."""
    blocks = index(vectors, vec_id, embedding)
    asked = query_blocks(queries, vec_id, embedding)
    groups = max(1, min(blocks.count(), GROUPS * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = blocks.withColumn("group", F.pmod(F.col("part") + F.col("seq"), F.lit(groups)))
    sent = asked.select("dims", F.col("ids").alias("q_ids"), "q_kind", "weights", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    met = dealt.join(sent, ["group", "dims"])

    def search(batches):
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                ids, asked_ids = (np.frombuffer(r[c], np.int64) for c in ("ids", "q_ids"))
                low, weights = unpacked(r["kind"], r["low"], r["dims"]), unpacked(r["q_kind"], r["weights"], len(asked_ids), r["dims"])
                slices = np.frombuffer(r["slices"], np.uint64).reshape(r["dims"], r["bits"], -1)
                found = [(q, *block_top(w, q, ids, low, slices, k)) for q, w in zip(asked_ids, weights, strict=True)]
                exact = [s for f in found for s in f[2]]
                fit = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in exact]
                columns = (np.repeat([f[0] for f in found], [len(f[1]) for f in found]), np.concatenate([f[1] for f in found]), fit, [a != b for a, b in zip(exact, fit, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["query_id", "vec_id", "score", "over"])

    hits = met.mapInArrow(search, HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.when(F.col("over"), F.raise_error(F.lit("a score does not fit a long")).cast("long")).otherwise(F.col("score")).alias("score"))
