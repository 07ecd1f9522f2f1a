"""Language-model scores by context-tree weighting over bytes.

A text is its words in lower case, one space between them and an end symbol. Every byte is eight
binary decisions, each with a context tree of its own over the preceding bytes. A tree node holds how
often a training text went on with 0 and with 1 there. Its Krichevsky-Trofimov estimate and the product
of its children's weighted probabilities are mixed half and half, from depth DEPTH up to the root; what
comes out of that is, for each node, the weight of stopping there. A prediction mixes the estimates of
all depths on a context's path by these weights. A context that training never met takes its parent's
estimate. The code length of a text is -score / log10(2) bits.

Nothing that grows with the corpus is collected or broadcast. Documents lie in blocks of BLOCK bytes. A
block sends its distinct grams (context and byte) once, sorted, packed and dealt to BUCKETS by a hash of
the last HEAD context bytes, and gets their probabilities back; so with its distinct words. Deeper tree levels are counted bucket by
bucket (at most 256^3 grams share the last three bytes of a context of five); the levels above are
ordinary aggregations. Buckets that many blocks ask are split by SALT: each part gets the bucket's model.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import materialise, mix64, runs_by_size, texts

DEPTH, HEAD = 5, 3
#: Bytes of text in a block (one document at least).
BLOCK = 1 << 24
BUCKETS = 1024
#: Blocks that ask one part of a bucket.
SALT = 512
#: Bytes of a block handled at once.
CHUNK = 1 << 21
#: Grams that are held before they are merged.
MERGE = 1 << 22
#: Ends a text, and stands for what precedes it; no byte of UTF-8.
END = 0xFF

BLOCKS = "block long, ids array<long>, trains array<boolean>, streams binary"
ASKS = "bucket int, block long, grams binary, n binary, words binary, word_n binary"
COUNTS = "bucket int, grams binary, n binary, words binary, word_n binary, tokens long, kinds long"
#: Level 1: the arrays are short, and many.
ZIP, UNZIP = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def zipped(raw: bytes) -> bytes:
    return ZIP.compress(raw)


def unzipped(blob: bytes) -> bytes:
    return UNZIP.decompress(blob)


def packed(x: np.ndarray) -> bytes:
    """Rising numbers as packed differences."""
    return zipped(np.diff(x, prepend=0).astype(np.int64).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(unzipped(blob), np.int64))


def packed_counts(n: np.ndarray) -> bytes:
    return zipped(n.astype(np.int64).tobytes())


def unpacked_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(unzipped(blob), np.int64)


def one_by_one(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def blocks_of(docs: DataFrame, train: Column, doc_id: str, text: str) -> DataFrame:
    """Documents in blocks, as normalised streams. Kept as a table, so that block numbers hold."""
    rows = docs.select(F.col(doc_id).cast("long"), F.coalesce(train, F.lit(False)), F.col(text))

    def pack(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("trains", pa.list_(pa.bool_())), ("streams", pa.binary())])

        def filled():
            ids, trains, streams = zip(*held, strict=True)
            whole = zipped(bytes([END]).join([*streams, b""]))
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], schema[1].type), pa.array([trains], schema[2].type), pa.array([whole])], schema=schema)

        for batch in batches:
            for i, t, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                stream = b" ".join(raw.lower().split())
                if held and size + len(stream) > BLOCK:
                    yield filled()
                    number, held, size = number + 1, [], 0
                held.append((i, t, stream))
                size += len(stream)
        if held:
            yield filled()

    return materialise(rows.mapInArrow(pack, BLOCKS), "text_blocks")


def streams_of(whole: bytes) -> list[bytes]:
    return unzipped(whole).split(bytes([END]))[:-1]


def grams_of(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram at each byte of all streams, and where each stream begins among them.

    A gram is the DEPTH bytes before, the last of them uppermost, and then the byte itself: grams that
    share the end of their context are neighbours in sorted order."""
    pad = bytes([END]) * DEPTH
    data = np.frombuffer(pad + b"".join(s + bytes([END]) + pad for s in streams), np.uint8)
    n = len(data) - DEPTH
    out = data[DEPTH:].astype(np.int64)
    for d in range(1, DEPTH + 1):
        out |= data[DEPTH - d : DEPTH - d + n].astype(np.int64) << 8 * (DEPTH + 1 - d)
    sizes = np.array([len(s) + 1 for s in streams], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + DEPTH)[:-1]]).astype(np.int64)
    own = np.ones(n, bool)
    for i in range(DEPTH):  # the padding between streams is predicted by none
        own[(first + sizes + i)[(first + sizes + i) < n]] = False
    return out[own], np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def by_bucket(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts rising grams by bucket, and the buckets in that order."""
    bucket = (mix64((grams >> 8 * (DEPTH + 1 - HEAD)).astype(np.uint64), 0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) % BUCKETS
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def runs(sorted_values: np.ndarray):
    """value, from, to of each run of equal values."""
    if len(sorted_values):
        edge = np.flatnonzero(np.diff(sorted_values)) + 1
        for at, to in zip([0, *edge.tolist()], [*edge.tolist(), len(sorted_values)], strict=True):
            yield int(sorted_values[at]), at, to


def chunks(streams: list[bytes]):
    return (slice(at, to) for at, to in runs_by_size([len(x) + 1 for x in streams], CHUNK))


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and the sums of their counts."""
    if len(held) == 1:
        return held[0]
    grams, inverse = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
    return grams, np.bincount(inverse, np.concatenate([n for _, n in held]), len(grams)).astype(np.int64)


def starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])[: len(sorted_values)])


def distinct(values: np.ndarray) -> np.ndarray:
    """By sorting: np.unique alone hashes, several times slower on grams."""
    values = np.sort(values)
    return values[starts(values)]


def distinct_grams(streams: list[bytes]) -> np.ndarray:
    return distinct(np.concatenate([distinct(grams_of(streams[c])[0]) for c in chunks(streams)]))


def looked_up(grams: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of grams, all of them among the rising known ones. Each distinct gram is searched once, in rising order."""
    order = np.argsort(grams)
    rising = grams[order]
    first = starts(rising)
    out = np.empty(len(grams))
    out[order] = np.repeat(values[np.searchsorted(known, rising[first])], np.diff(first, append=len(grams)))
    return out


def word_bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


def asks_of(blocks: DataFrame) -> DataFrame:
    """bucket, block, grams, n, words, word_n: the block's distinct grams and words (the empty word is
    the end), and how often its training texts have them."""

    def run(batches):
        for r in one_by_one(batches):
            streams = streams_of(r["streams"])
            seen = [s for s, t in zip(streams, r["trains"], strict=True) if t]
            held = [np.unique(grams_of(seen[c])[0], return_counts=True) for c in chunks(seen)]
            rest = [s for s, t in zip(streams, r["trains"], strict=True) if not t]
            if rest:
                new = distinct_grams(rest)
                held.append((new, np.zeros(len(new), np.int64)))
            every, n = summed(held)
            order, bucket = by_bucket(every)
            every, n = every[order], n[order]
            grams = {b: (every[i:j], n[i:j]) for b, i, j in runs(bucket)}
            times: Counter = Counter()
            for s in seen:
                times.update(s.split(b" ") if s else ())
            times[b""] = len(seen)
            times.update(dict.fromkeys({w for s in rest if s for w in s.split(b" ")} - times.keys(), 0))
            words: dict = {}
            for w in sorted(times):
                words.setdefault(word_bucket(w), []).append(w)
            none = np.zeros(0, np.int64)
            both = sorted(grams.keys() | words.keys())
            columns = [[*map(f, both)] for f in (lambda b: packed(grams.get(b, (none,))[0]), lambda b: packed_counts(grams.get(b, (none, none))[1]), lambda b: zipped(b" ".join(words[b])) if b in words else None, lambda b: packed_counts(np.array([times[w] for w in words.get(b, ())])))]
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.int32()), pa.array([r["block"]] * len(both), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "block", "grams", "n", "words", "word_n"])

    return materialise(blocks.select("block", "trains", "streams").mapInArrow(run, ASKS), "asks")


def words_in(r: dict) -> list[bytes]:
    return unzipped(r["words"]).split(b" ") if r["words"] is not None else []


def merged(asks: DataFrame) -> DataFrame:
    """bucket, grams, n, words, word_n over all blocks, a row per bucket; tokens and kinds of training words."""

    def run(batches):
        def row(bucket, held, times):
            grams, n = summed(held)
            words = sorted(times)
            blobs = [packed(grams), packed_counts(n), zipped(b" ".join(words)) if words else None, packed_counts(np.array([times[w] for w in words]))]
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs), pa.array([sum(times.values())], pa.int64()), pa.array([sum(n > 0 for n in times.values())], pa.int64())], names=["bucket", "grams", "n", "words", "word_n", "tokens", "kinds"])

        now, held, times = None, [], {}
        for r in one_by_one(batches):
            if held and r["bucket"] != now:
                yield row(now, held, times)
                held, times = [], {}
            now = r["bucket"]
            held.append((unpacked(r["grams"]), unpacked_counts(r["n"])))
            for w, n in zip(words_in(r), unpacked_counts(r["word_n"]).tolist(), strict=True):
                times[w] = times.get(w, 0) + n
            if sum(len(g) for g, _ in held[1:]) > max(MERGE, len(held[0][0])):
                held = [summed(held)]
        if held:
            yield row(now, held, times)

    dealt = asks.select("bucket", "grams", "n", "words", "word_n").repartition("bucket").sortWithinPartitions("bucket")
    return materialise(dealt.mapInArrow(run, COUNTS), "gram_counts")


def np_ln_gamma(x: np.ndarray) -> np.ndarray:
    z = x + 7.0
    low = reduce(np.multiply, [x + i for i in range(7)])
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(low)


def np_ln_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np_ln_gamma(n0 + 0.5) + np_ln_gamma(n1 + 0.5) - math.log(math.pi) - np_ln_gamma(n0 + n1 + 1.0)


def decisions(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (context, then a 1 and the bits so far) and bits of the eight decisions of each gram [8, grams]."""
    byte, context = grams & 255, grams >> 8 << 8
    return np.stack([context | 1 << i | byte >> 8 - i for i in range(8)]), np.stack([byte >> 7 - i & 1 for i in range(8)])


def parent(node: np.ndarray) -> np.ndarray:
    """The node with the same bits so far for a context without its first byte."""
    return node >> 16 << 8 | node & 255


def subtree(grams: np.ndarray, n: np.ndarray) -> list[dict]:
    """Levels DEPTH, ..., HEAD and the sums for HEAD - 1: node, n0, n1, kids, weighted, stop, up (its index above)."""
    node, bit = (x.ravel() for x in decisions(grams))
    ids, inverse = np.unique(node, return_inverse=True)
    times = np.tile(n, 8)
    level = {"node": ids, "n0": np.bincount(inverse, times * (1 - bit), len(ids)), "n1": np.bincount(inverse, times * bit, len(ids)), "kids": None}
    out = []
    for depth in range(DEPTH, HEAD - 1, -1):
        own = np_ln_estimate(level["n0"], level["n1"])
        if level["kids"] is None:
            level["weighted"], level["stop"] = own, np.ones(len(own))
        else:
            level["weighted"] = math.log(0.5) + np.logaddexp(own, level["kids"])
            level["stop"] = 1 / (1 + np.exp(np.minimum(level["kids"] - own, 700)))
        ids, level["up"] = np.unique(parent(level["node"]), return_inverse=True)
        out.append(level)
        level = {"node": ids} | {k: np.bincount(level["up"], level[x], len(ids)) for k, x in (("n0", "n0"), ("n1", "n1"), ("kids", "weighted"))}
    return [*out, level]


def found_in(nodes: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x is in sorted nodes, and whether it is."""
    at = np.minimum(np.searchsorted(nodes, x), max(0, len(nodes) - 1))
    return at, (nodes[at] == x) if len(nodes) else np.zeros(len(x), bool)


def bucket_scores(grams: np.ndarray, n: np.ndarray, nodes: np.ndarray, mixed: np.ndarray, left: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 probabilities of grams, given their nodes at depth HEAD - 1 (sorted) with what is mixed and
    left to mix there, and the probability of a 1 where the path ends there."""
    levels = subtree(grams[n > 0], n[n > 0])
    node, bit = decisions(grams)
    at, _ = found_in(nodes, reduce(lambda x, _: parent(x), range(DEPTH - HEAD + 1), node.ravel()))
    best = one[at]
    up, _ = found_in(nodes, levels[-1]["node"])
    mixed, left = mixed[up], left[up]
    for depth, level in zip(range(HEAD, DEPTH + 1), reversed(levels[:-1]), strict=True):
        kt = (level["n1"] + 0.5) / (level["n0"] + level["n1"] + 1.0)
        mixed = mixed[level["up"]] + left[level["up"]] * level["stop"] * kt
        left = left[level["up"]] * (1 - level["stop"])
        at, there = found_in(level["node"], reduce(lambda x, _: parent(x), range(DEPTH - depth), node.ravel()))
        if len(kt):
            best = np.where(there, (mixed + left * kt)[at], best)
    best = best.reshape(node.shape)
    return np.log10(np.where(bit == 1, best, 1 - best)).sum(0)


def ln_gamma(x: Column) -> Column:
    """For x of a half or more: Stirling's series at x + 7."""
    z = x + 7.0
    low = reduce(lambda a, b: a * b, [x + float(i) for i in range(7)])
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.ln(low)


def ln_estimate(n0: Column, n1: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return ln_gamma(n0 + 0.5) + ln_gamma(n1 + 0.5) - math.log(math.pi) - ln_gamma(n0 + n1 + 1.0)


def above(node: Column) -> Column:
    return F.shiftleft(F.shiftright(node, 16), 8).bitwiseOR(node.bitwiseAND(F.lit(255)))


def upper_levels(counts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """bucket, node for the nodes at depth HEAD - 1 that a bucket's grams need; and the levels HEAD - 1,
    ..., 0: node, n0, n1, stop."""

    def run(batches):
        for r in one_by_one(batches):
            grams, n = unpacked(r["grams"]), unpacked_counts(r["n"])
            need = np.unique(reduce(lambda x, _: parent(x), range(DEPTH - HEAD + 1), decisions(grams)[0].ravel()))
            sums = subtree(grams[n > 0], n[n > 0])[-1]
            at, there = found_in(sums["node"], need)
            column = lambda k: np.where(there, sums[k][at], 0.0) if there.any() else np.zeros(len(need))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(need), r["bucket"], np.int32)), pa.array(need), *(pa.array(column(k)) for k in ("n0", "n1", "kids"))], names=["bucket", "node", "n0", "n1", "kids"])

    needed = materialise(counts.select("bucket", "grams", "n").mapInArrow(run, "bucket int, node long, n0 double, n1 double, kids double"), "bucket_nodes")
    level, out = needed, []
    for depth in range(HEAD - 1, -1, -1):
        sums = level.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "kids")]).where("n0 + n1 > 0").withColumn("own", ln_estimate(F.col("n0"), F.col("n1")))
        more = F.greatest("own", "kids")
        mixed = sums.withColumn("weighted", math.log(0.5) + more + F.log1p(F.exp(F.least("own", "kids") - more))).withColumn("stop", 1 / (1 + F.exp(F.least(F.col("kids") - F.col("own"), F.lit(700.0)))))
        out.append(materialise(mixed.select("node", "n0", "n1", "weighted", "stop"), f"tree{depth}"))
        level = out[-1].select(above(F.col("node")).alias("node"), "n0", "n1", F.col("weighted").alias("kids"))
    return needed.select("bucket", "node"), out


def models(counts: DataFrame) -> DataFrame:
    """bucket, grams, n, nodes, mixed, left, one: all that a bucket needs to score its grams."""
    needed, levels = upper_levels(counts)
    asked, known = needed.withColumn("one", F.lit(0.5)).withColumn("mixed", F.lit(0.5)).withColumn("left", F.lit(0.0)), None
    for depth, level in enumerate(reversed(levels)):
        here = level.select("node", "stop", ((F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)).alias("kt"))
        if known is None:
            now = here.withColumns({"m": F.lit(0.0), "l": F.lit(1.0)})
        else:
            now = here.withColumn("up", above(F.col("node"))).join(known.select(F.col("node").alias("up"), "m", "l"), "up").drop("up")
        known = materialise(now.select("node", (F.col("m") + F.col("l") * F.col("stop") * F.col("kt")).alias("m"), (F.col("l") * (1 - F.col("stop"))).alias("l"), "kt"), f"mixed{depth}")
        at = reduce(lambda x, _: above(x), range(HEAD - 1 - depth), F.col("node"))
        one = F.col("m") + F.col("l") * F.col("kt")
        last = depth == HEAD - 1
        found = known.select(F.col("node").alias("at"), one.alias("o"), (F.col("m") if last else one).alias("m"), (F.col("l") if last else F.lit(0.0)).alias("l"))
        asked = asked.withColumn("at", at).join(found, "at", "left").select("bucket", "node", F.coalesce("o", "one").alias("one"), F.coalesce("m", "mixed").alias("mixed"), F.coalesce("l", "left").alias("left"))
    lists = asked.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("node", "mixed", "left", "one"))).alias("nodes"))
    return counts.join(lists, "bucket", "left").select("bucket", "grams", "n", "words", "word_n", "nodes")


def answers(asks: DataFrame, model: DataFrame, parts: int) -> DataFrame:
    """block, bucket, value (the asked grams' log10 probabilities, packed), words, word_n (in training)."""
    ask = asks.select("bucket", F.pmod(F.col("block") + F.shiftright("block", 32), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "block", "grams", F.lit(None).cast("binary").alias("n"), "words", F.lit(None).cast("binary").alias("word_n"), F.lit(None).cast(model.schema["nodes"].dataType).alias("nodes"))
    sent = model.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), "grams", "n", "words", "word_n", "nodes")

    def run(batches):
        grams = values = times = None
        for r in one_by_one(batches):
            if r["kind"] == 0:
                grams = unpacked(r["grams"])
                up = [np.array([x[k] for x in r["nodes"] or ()]) for k in ("node", "mixed", "left", "one")]
                values = bucket_scores(grams, unpacked_counts(r["n"]), *up).astype(np.float32) if len(grams) else np.zeros(0, np.float32)
                times = dict(zip(words_in(r), unpacked_counts(r["word_n"]).tolist(), strict=True))
            else:
                asked = unpacked(r["grams"])
                got = values[np.searchsorted(grams, asked)] if len(asked) else values[:0]
                blobs = [zipped(got.tobytes()), r["words"], packed_counts(np.array([times[w] for w in words_in(r)]))]
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["bucket"]], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], names=["block", "bucket", "value", "words", "word_n"])

    both = ask.unionByName(sent).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "kind")
    return both.mapInArrow(run, "block long, bucket int, value binary, words binary, word_n binary")


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """doc_id, n_tokens, n_known, base_score, score of each row of docs, and the training tokens.

    train says which rows are learnt from (null: not). Null and empty texts are one token, the end.
    Rows that repeat a doc_id are repeated, and each counts as training text. Without training rows
    every bit has probability 1/2 and no token is known. No rows: no rows. Gram probabilities are
    sent to the blocks in single precision."""
    blocks = blocks_of(docs, train, doc_id, text)
    asks = asks_of(blocks)
    parts = 1 + blocks.count() // SALT
    counts = merged(asks)
    total = counts.agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    tokens, kinds = total["tokens"] or 0, total["kinds"] or 0
    answered = answers(asks, models(counts), parts)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        values, base = {}, {}
        for batch in right.to_batches():
            for r in one_by_one([batch]):
                values[r["bucket"]] = np.frombuffer(unzipped(r["value"]), np.float32)
                base.update(zip(words_in(r), np.log10((unpacked_counts(r["word_n"]) + 0.5) / (tokens + 0.5 * (kinds + 1))).tolist(), strict=True))
        unknown = float(np.log10(0.5 / (tokens + 0.5 * (kinds + 1))))
        out: dict = {k: [] for k in ("doc_id", "n_tokens", "n_known", "base_score", "score")}
        for r in left.to_pylist():
            streams = streams_of(r["streams"])
            known = distinct_grams(streams)
            order, bucket = by_bucket(known)
            lp = np.zeros(len(known))
            lp[order] = np.concatenate([values[b] for b, _, _ in runs(bucket)])
            out["doc_id"] += r["ids"]
            for c in chunks(streams):
                found, first = grams_of(streams[c])
                out["score"] += np.add.reduceat(looked_up(found, known, lp), first).tolist()
                words, sizes = [], []
                for s in streams[c]:
                    own = s.split(b" ") if s else []
                    words += own
                    words.append(b"")
                    sizes.append(len(own) + 1)
                each = np.fromiter(map(base.__getitem__, words), float, len(words))
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
                out["n_tokens"] += sizes
                out["n_known"] += np.add.reduceat((each > unknown).astype(np.int64), first).tolist()
                out["base_score"] += np.add.reduceat(each, first).tolist()
        return pa.table({k: pa.array(v, pa.int64() if k[0] in "dn" else pa.float64()) for k, v in out.items()})

    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, SCORES), tokens
