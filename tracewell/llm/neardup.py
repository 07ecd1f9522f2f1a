"""Near-duplicates by similarity of word shingles: every pair of texts whose sets of five-word shingles
have a Jaccard similarity of 0.8 or more is linked.

SimHash fingerprints of the sets come first, with the pivot distance table of op2 to discard pairs: sets
at BITS or fewer are compared as whole sets, those of one fingerprint with one of them. That links copies
with few changes.

At a similarity of 0.8 fingerprints are some ten of 64 bits apart, too many for buckets of equal blocks,
and no limit of bits is sure to hold all similar pairs. So the links that fingerprints can't propose come
from prefixes: with the shingles of each set in one order for all texts, two
sets that similar share one of the first n - ceil(0.8 n) + 1 of their n. Any order is right. This one puts
shingles last that are common in a sample, so that a passage in many texts proposes few pairs. What a
prefix proposes goes by the links of fingerprints, size, position and parities and is then confirmed on the whole sets.

Parities are a few bytes for a set: bit k is set if an odd number of its shingles fall on k. Where two sets' bits
differ, a shingle is in one of them alone, so the count of such bits bounds what they can share. Pairs meet those
and not the prefixes, which are some eight times as long.

Groups of copies share whole prefixes, so all pairs are out of the question. First each text is compared
with a leader of its buckets, the text with the largest share of common shingles, which is the least
edited copy of a large group. In ROUNDS more, texts outside a bucket's largest component are compared
with a leader out of that. Then pairs of one bucket are compared only if the links so far leave them in
different components, and one of them is outside the bucket's largest. Leaders only save comparisons;
the links' components are those of all similar pairs.

A bucket with more than HOT texts outside its largest component would make pairs with the square of its
texts. The counts of all texts decide: its shingle goes to the end of the order, the texts that
had it in their prefix get a new one, and what they meet there is counted again, up to REORDERS times. So
a passage that unrelated texts share, of whatever length and however rare in the corpus, proposes nothing
unless it is most of them. What is still in such a bucket then is compared within bands of size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from tracewell.llm import simhash
from tracewell.llm.common import append_arrow, broadcast_below, discard, materialise, quoted, texts
from tracewell.llm.components import stars
from tracewell.llm.simhash import components, keep_lowest, signed

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = 4, 5
#: Bits up to which fingerprints propose pairs. More make keys of two equal blocks too short to select.
BITS = 3
#: Texts that the order is learned from, in how many of them a shingle is common, and most common ones.
SAMPLE, SEEN, COMMON = 5_000, 5, 100_000
#: Rounds in which leaders are chosen anew.
ROUNDS = 1
#: Texts outside a bucket's largest component up to which it makes pairs: as many for each text as a set has shingles,
#: which is what a text costs whose place in the order changes. How often the order may change.
HOT, REORDERS = 512, 4
#: Shingles moved to the end of the order up to which tasks get all of them; more meet the sets by shuffle.
LATE = 200_000
#: Sizes of similar sets are in the same band or in neighbouring ones: a band's sizes differ by a factor over 5/4.
BAND = 1.26
#: Texts to be confirmed up to which their ids are broadcast.
BROADCAST_IDS = 1_000_000
LONGS = ArrayType(LongType())


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes. Fewer words than a shingle: the whole sequence is one shingle."""
    if len(words) < shingle:
        grams, n = [b" ".join(words)], min(1, len(words))
    else:
        grams, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)), len(words) - shingle + 1
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in grams), np.uint64, n)).view(np.int64)


def prefix_length(n: int) -> int:
    """A set this similar to one of n shares at least ceil(n * LEAST) with it, so it meets the others and one."""
    return n - -(-n * LEAST[0] // LEAST[1]) + 1


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (shingles(x.lower().split()) for x in texts(batch.column("__text")))


def _named(s: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(s.tobytes(), 42))


def _fingerprint(s: np.ndarray) -> int:
    return signed(simhash.majority((s[at : at + simhash.CHUNK] for at in range(0, len(s), simhash.CHUNK)), len(s)))


def parities(s: np.ndarray) -> np.ndarray:
    """Bit k of as many as s has shingles, rounded up to a power of two: whether an odd number of shingles has remainder k."""
    bits = 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits(np.bincount(s & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def common(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the shingles common in a sample. Results don't depend on it."""
    total = docs.count()
    part = docs.sample(SAMPLE / total, seed=42) if total > SAMPLE else docs
    own = append_arrow(part.select(quoted(text).alias("__text")), [StructField("hs", LONGS)], lambda: lambda batch: [_lists(list(_sets(batch)))], "__text")
    counts = own.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    rows = sorted(counts.orderBy(F.desc("n"), "h").limit(COMMON).collect())
    return np.array([r.h for r in rows], np.int64), np.array([r.n for r in rows], np.int64)


def order_of(hashes: np.ndarray, counts: np.ndarray):
    """How often each of a set's shingles is in the sample, and their places in the order of all texts."""

    def ordered(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = np.zeros(len(s), np.int64)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
            weight = np.where(hashes[at] == s, counts[at], 0)
        return weight, np.lexsort((s, weight))

    return ordered


def prefixes(docs: DataFrame, doc_id: str, text: str, ordered) -> DataFrame:
    """doc_id, fp (names the set of shingles), n (its size), w (how many of 100 are common), sim (its SimHash
    fingerprint), bits (its parities), prefix of each row."""

    def prefix(s: np.ndarray) -> tuple[int, np.ndarray]:
        weight, order = ordered(s)
        return 100 * np.count_nonzero(weight) // max(1, len(s)), s[order][: prefix_length(len(s))]

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        names, sizes, shares, sims, bits, heads = [], [], [], [], [], []
        for s in _sets(batch):
            names.append(_named(s))
            sizes.append(len(s))
            share, head = prefix(s)
            shares.append(share)
            sims.append(_fingerprint(s))
            bits.append(parities(s))
            heads.append(head)
        return [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shares, pa.int32()), pa.array(sims, pa.int64()), _lists(bits), _lists(heads)]

    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("__text"))
    fields = [StructField("fp", LongType()), StructField("n", LongType()), StructField("w", IntegerType()), StructField("sim", LongType()), StructField("bits", LONGS), StructField("prefix", LONGS)]
    return append_arrow(rows, fields, lambda: make, "__text").select("doc_id", "fp", "n", "w", "sim", "bits", "prefix")


def may(na: str, ia: str, nb: str, ib: str) -> Column:
    """Whether sets of na and nb shingles can be similar enough if those at ia and ib are the first that
    they share, in the order of prefixes: no more can be shared than either has from there on."""
    na, ia, nb, ib = (F.col(x) for x in (na, ia, nb, ib))
    return enough(F.least(na - ia, nb - ib), na, nb)


def enough(shared: Column, na: Column, nb: Column) -> Column:
    return shared * (LEAST[0] + LEAST[1]) >= (na + nb) * LEAST[0]


def shared_at_most(na: str, ba: str, nb: str, bb: str) -> Column:
    """How many shingles sets of na and nb, of similar size, share at most by their parities ba and bb. Where one
    has twice the bits of the other its halves are added up first."""
    a, b = F.col(ba), F.col(bb)
    xor = lambda x, y: x.bitwiseXOR(y)
    halved = lambda x, to: F.when(F.size(x) > F.size(to), F.zip_with(F.slice(x, 1, F.size(to)), F.slice(x, F.size(to) + 1, F.size(to)), xor)).otherwise(x)
    apart = F.aggregate(F.zip_with(halved(a, b), halved(b, a), xor), F.lit(0), lambda n, x: n + F.bit_count(x))
    return F.floor((F.col(na) + F.col(nb) - apart) / 2)


def behind(n: str) -> Column:
    """How many shingles of a set of n are not in its prefix."""
    return F.expr(f"({n} * {LEAST[0]} + {LEAST[1] - 1}) div {LEAST[1]} - 1")


def confirmed(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Those of pairs (u, v) whose sets are similar: by sizes and parities, then on the whole sets of the texts
    that name them. The table pairs is gone after that."""
    ends = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct()
    heads = materialise(distinct.select("fp", "n", "bits").join(ends, "fp"), "heads")
    a, b = (heads.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}")).hint("merge") for x in "uv")
    sized = pairs.join(b, "v").join(a, "u").where(enough(F.least("nu", "nv"), F.col("nu"), F.col("nv")))
    likely = materialise(sized.where(enough(shared_at_most("nu", "bu", "nv", "bv"), F.col("nu"), F.col("nv"))).select("u", "v"), "likely")
    discard(heads, pairs)
    pairs = likely
    asked = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct()
    asked = materialise(asked.join(distinct.select("fp", "rep"), "fp"), "asked")
    ids = broadcast_below(asked.select(F.col("rep").alias("doc_id")).where("doc_id IS NOT NULL"), BROADCAST_IDS)
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("__text"))
    rows = rows.join(ids, "doc_id", "left_semi").union(rows.where("doc_id IS NULL")).select("__text")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        own = list(_sets(batch))
        return [pa.array([_named(s) for s in own], pa.int64()), _lists(own)]

    whole = append_arrow(rows, [StructField("fp", LongType()), StructField("hs", LONGS)], lambda: make, "__text").select("fp", "hs")
    whole = materialise(whole.groupBy("fp").agg(F.first("hs").alias("hs")), "whole")
    a, b = (whole.select(F.col("fp").alias(x), F.col("hs").alias(f"h{x}")).hint("merge") for x in "uv")
    both = pairs.join(b, "v").join(a, "u")
    found = materialise(both.where(enough(F.size(F.array_intersect("hu", "hv")), F.size("hu"), F.size("hv"))).select("u", "v"), "links")
    discard(asked, whole, pairs)
    return found


def hashed(distinct: DataFrame) -> DataFrame:
    """u, v: a table of the pairs of sets (fp, sim) that fingerprints propose: what simhash.links lets pass of
    different ones, by their least fp, and each set with the least fp of its fingerprint."""
    sims = materialise(distinct.groupBy("sim").agg(F.min("fp").alias("m")), "sims")
    equal = distinct.select("fp", "sim").join(sims, "sim").where("fp <> m").select(F.col("fp").alias("u"), F.col("m").alias("v"))
    a, b = (sims.select(F.col("sim").alias(x), F.col("m").alias(f"m{x}")) for x in "uv")
    close = simhash.links(sims.select(F.col("sim").alias("fp")), BITS).join(b, "v").join(a, "u")
    return materialise(equal.union(close.select("mu", "mv")), "hashed")


def apart(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """Those of pairs (u, v) that links so far (fp, root) leave apart. The table pairs is gone after that."""
    a, b = (root.select(F.col("fp").alias(x), F.col("root").alias(f"r{x}")) for x in "uv")
    both = pairs.join(b, "v", "left").join(a, "u", "left")
    out = materialise(both.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v"), "apart")
    discard(pairs)
    return out


def led(rows: DataFrame) -> DataFrame:
    """u, v: each set (fp, n) and the leader (m) that it meets in most of rows, where that may be similar."""
    best = rows.where("fp <> m").groupBy("fp", "n", "m").agg(F.count("*").alias("c")).groupBy("fp", "n").agg(F.max(F.struct("c", "m")).alias("best"))
    # A quarter of what two sets of this size share, as m may not lead in all buckets they share.
    best = best.where(enough(4 * F.col("best.c") + behind("n"), F.col("n"), F.col("n")))
    return materialise(best.select(F.col("fp").alias("u"), F.col("best.m").alias("v")), "led")


def roots(found: DataFrame) -> DataFrame:
    return stars(found).select(F.col("u").alias("fp"), F.col("v").alias("root"))


def mixed(rows: DataFrame, root: DataFrame) -> DataFrame:
    """h, fp, n, i, root, major of rows whose bucket has more than one component (root); major is the largest.
    The table rows is gone after that."""
    rooted = materialise(rows.select("h", "fp", "n", "i").join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    shares = rooted.groupBy("h", "root").agg(F.count("*").alias("size"))
    several = shares.groupBy("h").agg(F.max_by("root", F.struct("size", "root")).alias("major"), F.count("*").alias("roots")).where("roots > 1")
    out = materialise(rooted.join(materialise(several.select("h", "major"), "mixed"), "h"), "mixed_rows")
    discard(rooted, rows)
    return out


def met_in(left: DataFrame) -> DataFrame:
    """u, v: pairs of rows of mixed() that one bucket and sizes allow and links so far leave apart."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))).cast("int")
    a = left.where("root <> major").withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    pairs = a.alias("a").join(left.withColumn("band", band).alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.root") != F.col("b.root")))
    once = (F.col("b.root") == F.col("b.major")) | (F.col("a.fp") > F.col("b.fp"))
    return pairs.where(once & may("a.n", "a.i", "b.n", "b.i")).select(F.greatest("a.fp", "b.fp").alias("u"), F.least("a.fp", "b.fp").alias("v")).distinct()


def whole_sets(fps: DataFrame, distinct: DataFrame, docs: DataFrame, doc_id: str, text: str, ordered) -> DataFrame:
    """fp, hs: all shingles of some sets, in the order of all texts."""
    asked = materialise(distinct.join(fps, "fp", "left_semi").select("rep"), "asked")
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("__text"))
    ids = broadcast_below(asked.select(F.col("rep").alias("doc_id")).where("doc_id IS NOT NULL"), BROADCAST_IDS)
    rows = rows.join(ids, "doc_id", "left_semi").union(rows.where("doc_id IS NULL")).select("__text")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        own = list(_sets(batch))
        return [pa.array([_named(s) for s in own], pa.int64()), _lists([s[ordered(s)[1]] for s in own])]

    made = append_arrow(rows, [StructField("fp", LongType()), StructField("hs", LONGS)], lambda: make, "__text").select("fp", "hs")
    out = materialise(made.join(fps, "fp", "left_semi").groupBy("fp").agg(F.first("hs").alias("hs")), "whole_sets")
    discard(asked)
    return out


def new_prefixes(sets: DataFrame, late: DataFrame) -> DataFrame:
    """h, fp, n, i: the prefixes of whole sets when late shingles (h, turn) come last."""
    known = late.limit(LATE + 1).collect()
    if len(known) > LATE:
        every = sets.select("fp", F.size("hs").cast("long").alias("n"), F.posexplode("hs").alias("at", "h")).join(late, "h", "left")
        place = F.row_number().over(Window.partitionBy("fp").orderBy(F.coalesce("turn", F.lit(0)), "at"))
        return every.withColumn("place", place).where(F.col("place") <= F.col("n") - behind("n")).select("h", "fp", "n", (F.col("place") - 1).alias("i"))
    known.sort()
    hashes, turns = np.array([r.h for r in known], np.int64), np.array([r.turn for r in known], np.int64)

    def prefix(s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
        return s[np.argsort(np.where(hashes[at] == s, turns[at], 0), kind="stable")][: prefix_length(len(s))]

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        own = [np.array(s, np.int64) for s in batch.column("hs").to_pylist()]
        return [pa.array([len(s) for s in own], pa.int64()), _lists([prefix(s) for s in own])]

    heads = append_arrow(sets, [StructField("n", LongType()), StructField("prefix", LONGS)], lambda: make, "hs")
    return heads.select("fp", "n", F.posexplode("prefix").alias("i", "h")).select("h", "fp", "n", "i")


def proposed(left: DataFrame, rows: DataFrame, root: DataFrame, distinct: DataFrame, docs: DataFrame, doc_id: str, text: str, ordered) -> DataFrame:
    """u, v: a table of the pairs that remain to be compared. left: rows of mixed() in the first order; it is gone
    after that. rows: h, fp, n, i of all prefixes."""
    pairs, late, sets = [], None, None
    for turn in range(1, REORDERS + 2):
        counts = left.groupBy("h").agg(F.count_if(F.col("root") != F.col("major")).alias("outside")).where(F.col("outside") > HOT).select("h")
        hot = materialise(counts if late is None else counts.join(late, "h", "left_anti"), "hot")
        if turn > REORDERS or hot.isEmpty():
            pairs.append(materialise(met_in(left), "pairs"))
            discard(left, hot, *([sets] if sets is not None else []))
            break
        pairs.append(materialise(met_in(left.join(hot, "h", "left_anti")), "pairs"))
        fps = materialise(left.join(hot, "h", "left_semi").select("fp").distinct(), "moved")
        new = fps if sets is None else fps.join(sets, "fp", "left_anti")
        more = whole_sets(new, distinct, docs, doc_id, text, ordered)
        sets = more if sets is None else sets.union(more)
        turned = hot.withColumn("turn", F.lit(turn))
        late = turned if late is None else late.union(turned)
        discard(fps)
        discard(left)
        moved = materialise(new_prefixes(sets, late), "moved_rows")
        others = rows.join(sets.select("fp"), "fp", "left_anti").join(moved.select("h").distinct(), "h", "left_semi")
        every = materialise(moved.union(others.select("h", "fp", "n", "i")), "moved_shared")
        discard(moved)
        left = mixed(every, root)
    once = materialise(reduce(DataFrame.union, pairs).distinct(), "mixed_pairs")
    discard(*pairs)
    return once


def links(distinct: DataFrame, docs: DataFrame, doc_id: str, text: str, ordered) -> DataFrame:
    """u, v: links between sets (fp, rep, n, w, sim, bits, prefix) with the components of all similar pairs."""
    close = confirmed(hashed(distinct), distinct, docs, doc_id, text)
    rows = distinct.select("fp", "n", "w", F.posexplode("prefix").alias("i", "h"))
    met = rows.groupBy("h").agg(F.max(F.struct("w", "fp")).alias("lead"), F.count("*").alias("size")).where("size > 1")
    met = materialise(met.select("h", F.col("lead.fp").alias("m")), "met")
    shared = materialise(rows.drop("w").join(met.hint("merge"), "h"), "shared")
    discard(met)
    found = close.union(confirmed(apart(led(shared), roots(close)), distinct, docs, doc_id, text))
    left = mixed(shared, roots(found))
    for r in range(ROUNDS):
        leads = left.where("root = major").groupBy("h").agg(F.max_by("fp", F.xxhash64(F.lit(r), "fp")).alias("m"))
        more = left.where("root <> major").join(leads.hint("merge"), "h")
        found = found.union(confirmed(led(more), distinct, docs, doc_id, text))
        root = roots(found)
        left = mixed(left, root)
    return found.union(confirmed(proposed(left, rows, root, distinct, docs, doc_id, text, ordered), distinct, docs, doc_id, text))


def clusters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id of each row, as those of simhash.clusters. Texts without words are equal."""
    ordered = order_of(*common(docs, text))
    fps = materialise(prefixes(docs, doc_id, text, ordered), "prefixes")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("w").alias("w"), F.first("sim").alias("sim"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
    distinct = materialise(distinct, "distinct")
    ids, reps = materialise(fps.select("doc_id", "fp"), "ids"), materialise(distinct.select("fp", "rep"), "reps")
    discard(fps)
    found = links(distinct, docs, doc_id, text, ordered)
    discard(distinct)
    return components(ids, reps, found)


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of docs with the smallest doc_id of each component, as simhash.keep_lowest has it.

    Null texts and texts without words are copies of one another. No rows: no rows."""
    return keep_lowest(docs, clusters(docs, doc_id, text), doc_id)
