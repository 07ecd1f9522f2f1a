"""SimHash near-duplicates, with a pivot distance table to discard pairs.

A document's fingerprint has 64 bits: bit i is set if it is set in over half of the XXH64 hashes of
its word shingles. Every distinct fingerprint gets a row in the pivot table: its Hamming distances to
PIVOTS fixed reference fingerprints, packed eight to a long. By the triangle inequality two
fingerprints at distance d have coordinates that differ by d at most, so a pair whose largest
coordinate difference is over the limit is discarded on the table alone; survivors are verified.

A pivot table judges pairs but doesn't propose them, and all pairs are out of the question. With two
bits apart at most, two of four 16-bit blocks are equal; the pairs come from buckets of such block
pairs. A bucket of more than BUCKET fingerprints (copies of one text with small changes) proposes
no pairs: its members go by probes, one for each fingerprint at one bit or less, and two fingerprints
share a probe exactly if they are two bits apart or less. That is linear in the bucket and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tracewell.llm.common import append_arrow, fresh, materialise, quoted, texts
from tracewell.llm.components import stars

PIVOTS = 16
BUCKET = 32
MAX_BITS = 2
#: Shingles hashed and counted at once.
CHUNK = 1 << 15


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """Unsigned; zero for no words. Fewer words than a shingle: the whole sequence is one shingle."""
    n = max(1, len(words) - shingle + 1) if words else 0

    def hashes():
        for at in range(0, n, CHUNK):
            part = words[at : min(n, at + CHUNK) + shingle - 1]
            grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
            yield np.array([xxhash.xxh64_intdigest(x, seed) for x in grams], np.uint64)

    return majority(hashes(), n)


def majority(parts: Iterable[np.ndarray], n: int) -> int:
    """The bits set in over half of n hashes, which come in parts of about CHUNK."""
    ones = np.zeros(64, np.int64)
    for h in parts:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > n))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row; a null text has no words."""

    def start():
        return lambda batch: [pa.array([signed(fingerprint(x.lower().split(), shingle)) for x in texts(batch.column("__text"))], pa.int64())]

    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("__text"))
    return append_arrow(rows, [StructField("fp", LongType())], start, "__text").select("doc_id", "fp")


def pivots(n: int = PIVOTS) -> list[int]:
    """The reference fingerprints: fixed and random-like, so that no corpus is favoured."""
    return [signed(xxhash.xxh64_intdigest(str(i).encode(), 0)) for i in range(n)]


def pivot_table(fps: DataFrame) -> DataFrame:
    """fps with t0, t1, ...: the distances to the pivots, a byte each."""
    out = {}
    for k in range(0, PIVOTS, 8):
        packed = F.lit(0).cast("long")
        for i, p in enumerate(pivots()[k : k + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * i))
        out[f"t{k // 8}"] = packed
    return fps.withColumns(out)


def coordinates_within(limit: int) -> Column:
    """Whether no coordinate of a and b differs by more than limit."""
    ok = F.lit(True)
    for k in range(PIVOTS // 8):
        for i in range(8):
            c = [F.shiftrightunsigned(F.col(f"{x}.t{k}"), 8 * i).bitwiseAND(F.lit(255)) for x in "ab"]
            ok = ok & (F.abs(c[0] - c[1]) <= limit)
    return ok


def block_keys(bits: int = MAX_BITS) -> Column:
    """For each pair of bits + 2 blocks, the pair's number and value: with so many bits apart two blocks are equal."""
    ends = [64 * i // (bits + 2) for i in range(bits + 3)]
    block = lambda i: F.shiftrightunsigned("fp", ends[i]).bitwiseAND(F.lit((1 << ends[i + 1] - ends[i]) - 1))
    return F.array(*[F.shiftleft(block(a), 16).bitwiseOR(block(b)).bitwiseOR(F.lit(n << 32)) for n, (a, b) in enumerate(combinations(range(bits + 2), 2))])


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that leave its components as they are.

    Small buckets propose all their pairs, and a probe pairs its members with the lowest of them. Every
    proposed pair goes by the pivot table and is then verified. With more bits than MAX_BITS, crowded
    buckets still propose pairs at MAX_BITS only."""
    table = materialise(pivot_table(distinct.select("fp")), "pivots")
    keys = table.withColumn("k", F.explode(block_keys(bits)))
    sizes = materialise(keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    small = materialise(keys.join(sizes.where(F.col("n") <= BUCKET), "k").drop("n"), "small_buckets")
    pairs = small.alias("a").join(small.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp")))
    crowded = materialise(keys.join(sizes.where(F.col("n") > BUCKET), "k").select("fp").distinct(), "crowded")
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    probes = crowded.select("fp", F.explode(flips).alias("probe"))
    met = materialise(probes.groupBy("probe").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1").select("probe", "m"), "probes")
    starred = probes.join(met, "probe").where("fp <> m").select("fp", "m").distinct()
    led = starred.join(table, "fp").alias("a").join(table.alias("b"), F.col("a.m") == F.col("b.fp"))
    return near(pairs, bits).union(near(led, bits)).distinct()


def near(pairs: DataFrame, bits: int) -> DataFrame:
    """u, v: pairs of rows a and b of the pivot table that the table lets pass and their bits confirm."""
    verified = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits
    return pairs.where(coordinates_within(bits)).where(verified).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def clusters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links) of each row of docs.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id
    are repeated. A null doc_id names no component unless it is alone: then component_id is null.
    Equal fingerprints meet in one row before any pair is looked at. No rows: no rows."""
    fps = materialise(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    return components(fps, distinct, links(distinct))


def components(fps: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of fps (doc_id, fp), from the smallest doc_id of each fp (fp, rep) and links over fp."""
    star = stars(edges)
    rooted = distinct.join(star.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    rooted = materialise(rooted.select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    low = materialise(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "components")
    named = materialise(rooted.join(low, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of docs with the smallest doc_id of each component, as keep_lowest has it.

    Columns of docs may have any names and keep their order. Null and empty texts are copies of one
    another. No rows: no rows."""
    return keep_lowest(docs, clusters(docs, doc_id, text), doc_id)


def keep_lowest(docs: DataFrame, clustered: DataFrame, doc_id: str) -> DataFrame:
    """The row of docs with the smallest doc_id of each component (doc_id, component_id); rows without
    doc_id stay. Of rows that repeat that doc_id the one whose columns, as JSON, come first stays."""
    grouped = materialise(clustered, "clusters")
    kept = materialise(grouped.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    own = fresh(docs, "kept_id")
    ids = lambda rows: rows.select(F.col("doc_id").alias(own))
    # The kept ids grow with the corpus, so the join is a shuffle at every size.
    out = docs.join(ids(kept.where("n = 1")).hint("merge"), quoted(doc_id) == F.col(own), "left_semi").union(docs.where(quoted(doc_id).isNull()))
    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return out
    order, nth = F.to_json(F.struct(*[quoted(c) for c in docs.columns])), fresh(docs, "nth")
    ranked = docs.join(ids(repeated), quoted(doc_id) == F.col(own), "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(quoted(doc_id)).orderBy(order)))
    return out.union(ranked.where(F.col(nth) == 1).drop(nth))
