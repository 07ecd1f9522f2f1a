"""Shards of near-equal bytes by sampled splitters, by DataFrame functions alone.

A record's key is a hash of its text, so equal texts have equal keys. Records are sampled with a chance in
proportion to their size, and quantiles of the sample are the boundaries of ranges of about equal bytes, many
more than there are shards. A range that turns out overfull is subdivided: by a second hash of the text
while that helps, which keeps equal texts together, and what is still overfull (a group of copies) by
document. What is left are cells of bounded size, however many rows share a text. Their counted sizes
decide: whole ranges and groups go to shards, the largest first, each to the shard with the least so far;
a group goes in pieces only where shards of equal size are impossible otherwise.

Slots are numbered within a cell and shifted by the rows of the shard's cells before it, so that no task
sees a whole shard.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import broadcast_below, materialise, quoted

LAW = "bytes"
#: Bytes of a range to aim at, and the numbers of ranges that are made at least and at most.
RANGE_BYTES, LEAST, MOST = 128 << 20, 1024, 1 << 16
#: Sampled keys for each range.
PER_RANGE = 16
#: Keys are hashes of so many bits (whole in a double); boundaries are looked up by the upper GRID of them.
KEY_BITS, GRID = 52, 12
#: A shard may be larger than the mean by this share before groups go in pieces.
UNEVEN = 0.002
#: Cells that are broadcast at most; beyond that they meet their records by shuffle.
BROADCAST_CELLS = 200_000
CELL = ["range", "part", "piece"]


def size(text: Column) -> Column:
    """UTF-8 bytes (none for null) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def checksum(text: Column) -> Column:
    """crc32 of the UTF-8 bytes, unsigned; of no bytes for null."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


@dataclass(frozen=True)
class Plan:
    """Where records go: `bounds` has the ranges' lower ends by grid cell, `parts` and `cells` the
    subdivision, `cells` also each cell's shard and its first slot."""

    bounds: DataFrame  # grid, first, ends
    parts: DataFrame  # range, parts
    pieces: DataFrame  # range, part, pieces
    cells: DataFrame  # range, part, piece, shard, offset


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, size, text_crc32, key, key2: all that is needed of a record, so that texts are read once."""
    t = quoted(text)
    return docs.select(quoted(doc_id).alias("doc_id"), size(t).alias("size"), checksum(t).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(t), 64 - KEY_BITS).alias("key"), F.xxhash64(F.lit(1), t).alias("key2"))


def grid(key: str) -> Column:
    return F.shiftright(key, KEY_BITS - GRID).cast("int")


def ranges_of(records: DataFrame, total: int, n: int) -> DataFrame:
    """grid, first, ends: the boundaries in each part of the key space, and how many lie before it.

    A key is sampled once for each `step` bytes, rounded at random; every PER_RANGE-th sampled one is a boundary."""
    step = max(1.0, total / (n * PER_RANGE))
    chance = F.pmod(F.xxhash64(F.lit(2), "doc_id", "key2"), F.lit(1 << 30)) / float(1 << 30)
    sample = records.select("key", F.floor(F.col("size") / step + chance).alias("n")).where("n > 0").groupBy("key").agg(F.sum("n").alias("n")).withColumn("grid", grid("key"))
    by_cell = materialise(sample.groupBy("grid").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("keys"), F.sum("n").alias("n")), "shard_sample")
    all_before = lambda x: F.coalesce(F.sum(x).over(Window.orderBy("grid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # noqa: E731  4,096 rows at most
    each = by_cell.withColumn("before", all_before("n")).select("grid", "before", F.inline("keys"))
    to = F.col("before") + F.sum("n").over(Window.partitionBy("grid").orderBy("key"))
    crosses = F.floor(to / PER_RANGE) > F.floor((to - F.col("n")) / PER_RANGE)
    ends = each.select("grid", "key", crosses.alias("crosses")).groupBy("grid").agg(F.sort_array(F.collect_list(F.when(F.col("crosses"), F.col("key")))).alias("ends"))
    full = records.sparkSession.range(1 << GRID).select(F.col("id").cast("int").alias("grid")).join(ends, "grid", "left").withColumn("ends", F.coalesce("ends", F.array().cast("array<long>")))
    return materialise(full.select("grid", all_before(F.size("ends")).alias("first"), "ends"), "shard_bounds")


def in_ranges(records: DataFrame, bounds: DataFrame) -> DataFrame:
    """records with `range`: how many boundaries are no larger than the key."""
    met = records.withColumn("grid", grid("key")).join(F.broadcast(bounds), "grid")  # 4,096 rows, MOST ends
    return met.withColumn("range", (F.col("first") + F.size(F.filter("ends", lambda e: e <= F.col("key")))).cast("int")).drop("grid", "first", "ends")


def subdivided(sizes: DataFrame, by: list[str], name: str, mean: float) -> DataFrame:
    """by..., name: in how many parts each of the overfull ones goes."""
    over = sizes.groupBy(*by).agg(F.sum("size").alias("size")).where(F.col("size") > 2 * mean)
    return materialise(over.select(*by, F.ceil(F.col("size") / mean).cast("int").alias(name)), f"shard_{name}")


def in_cells(records: DataFrame, parts: DataFrame, pieces: DataFrame | None) -> DataFrame:
    """records (with range) with part and piece."""
    out = records.join(broadcast_below(parts, BROADCAST_CELLS), "range", "left").withColumn("part", F.pmod("key2", F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    if pieces is None:
        return out
    out = out.join(broadcast_below(pieces, BROADCAST_CELLS), ["range", "part"], "left")
    return out.withColumn("piece", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")


def dealt(cells: list[tuple], shards: int) -> list[tuple]:
    """cells (range, part, piece, size, rows) as (range, part, piece, shard, first slot).

    Cells of one (range, part) stay together while they are no larger than `limit`, which is halved until
    no shard is more than UNEVEN above the mean, or every cell goes its own way."""
    total = sum(c[3] for c in cells)
    mean = limit = max(1.0, total / shards)
    whole: dict[tuple, list[tuple]] = {}
    for c in sorted(cells):
        whole.setdefault(c[:2], []).append(c)
    largest = max((c[3] for c in cells), default=0)
    while True:
        units = [u for group in whole.values() for u in ([group] if sum(c[3] for c in group) <= limit else [[c] for c in group])]
        units.sort(key=lambda u: (-sum(c[3] for c in u), u[0][:3]))
        heap, out, rows = [(0, s) for s in range(shards)], [], [0] * shards
        for u in units:
            held, s = heapq.heappop(heap)
            heapq.heappush(heap, (held + sum(c[3] for c in u), s))
            for c in u:
                out.append((*c[:3], s, rows[s]))
                rows[s] += c[4]
        if max(heap)[0] <= mean * (1 + UNEVEN) or limit < largest:
            return out
        limit /= 2


def plan(records: DataFrame, shards: int = 16) -> Plan:
    """The plan for records of keyed(), a table. The driver sees counts by cell, at most a few for each
    range, and no record."""
    spark = records.sparkSession
    total = records.agg(F.sum("size")).first()[0] or 0
    n = max(LEAST, min(MOST, total // RANGE_BYTES))
    mean = max(1.0, total / n)
    bounds = ranges_of(records, total, n)
    ranged = in_ranges(records, bounds)
    parts = subdivided(ranged, ["range"], "parts", mean)
    pieces = subdivided(in_cells(ranged, parts, None), ["range", "part"], "pieces", mean)
    counts = in_cells(ranged, parts, pieces).groupBy(*CELL).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    cells = dealt([tuple(r) for r in counts.collect()], shards)
    return Plan(bounds, parts, pieces, materialise(spark.createDataFrame(cells, "range int, part int, piece int, shard int, offset long"), "shard_cells"))


def placed(records: DataFrame, where: Plan) -> DataFrame:
    """records (doc_id, key, key2 and any others) with range, part, piece, shard and offset; no row is shuffled while the
    plan's tables are small."""
    cells = in_cells(in_ranges(records, where.bounds), where.parts, where.pieces)
    return cells.join(broadcast_below(where.cells, BROADCAST_CELLS), CELL)


def assign(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs; only the two columns are read.

    The law is `bytes`: sizes of shards are near equal, as far as single documents allow. Equal texts are in one
    shard, unless their group is too large for that. Slots of a shard run from 0 without a gap. A null text
    has size 1 and is no copy of an empty one, which has size 1, too. Rows that repeat a doc_id, or have none,
    get slots of their own. Growing a shard count moves rows under this law, so grown_shard is null. No
    rows: no rows."""
    records = materialise(keyed(docs, doc_id, text), "shard_records")
    out = placed(records, plan(records, shards))
    nth = F.row_number().over(Window.partitionBy(*CELL).orderBy("doc_id", "key", "key2")) - 1
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("offset") + nth).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a last column `shard` (one of that name gives way), to be written with partitionBy("shard"). Texts stay
    where they are: their shard follows from the row itself and the plan's small tables."""
    records = materialise(keyed(docs, doc_id, text), "shard_records")
    where = plan(records, shards)
    names = [c for c in docs.columns if c.lower() != "shard"]
    inner = docs.select(F.struct(*[quoted(c) for c in names]).alias("row"), quoted(doc_id).alias("doc_id"), F.shiftrightunsigned(F.xxhash64(quoted(text)), 64 - KEY_BITS).alias("key"), F.xxhash64(F.lit(1), quoted(text)).alias("key2"))
    return placed(inner, where).select(*[F.col("row").getField(c).alias(c) for c in names], "shard")
