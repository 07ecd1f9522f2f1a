"""Language identification with n-gram filters that return language bitmasks.

Each language has a Bloom filter of its common byte n-grams. The filters share their hash functions
and are stored bit-sliced: position p of the table holds one bit per language, so k lookups and k-1
ANDs give the set of all languages that contain an n-gram. A text's n-grams yield a popcount per
language; the count expected from false positives is taken off, and the largest count decides.

Fitting counts n-grams on a bounded sample (`per_lang` texts of each language at most, in
expectation, chosen by a hash of doc_id). A language's filter takes the n-grams with a share of at
least `floor` of the language's n-grams of that order and at least `ratio` times the largest share
in any language, so n-grams quoted from other languages stay out. At most orders/floor n-grams per
language reach the driver, and the table is broadcast: its size depends on the languages alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField

from tracewell.llm.common import append_arrow, mix64, runs_by_size, texts

ORDERS = (2, 3, 4)
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
UNDETERMINED = "und"
#: Bytes of text handled at once in a task.
CHUNK = 1 << 19
#: Lower-cases A-Z and turns other ASCII characters that are no letters into spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class LanguageModel:
    """langs: by training texts, then name. planes[i, p]: bits of langs 8i..8i+7 at position p.
    fpr: each language's share of false positives."""

    langs: tuple[str, ...]
    planes: np.ndarray
    fpr: np.ndarray


def folded(raw: bytes) -> bytes:
    """The words of a text in lower case, each between single spaces."""
    if not raw.isascii():
        raw = raw.decode("utf-8", "replace").lower().encode()
    return b" " + b" ".join(raw.translate(FOLD).split()) + b" "


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that starts at each byte, with its order in the upper bits."""
    out = np.full(max(0, len(data) - n + 1), n, np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | data[i : len(data) - n + 1 + i].astype(np.uint64)
    return out


def positions(gram: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix64(gram, c) >> np.uint64(64 - bits)).astype(np.int64) for c in HASHES]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 3000, floor: float = 2e-5, ratio: float = 0.3) -> LanguageModel:
    """Learns from rows with a non-null language and text. Without such rows no language is known."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel((), np.zeros((1, 2), np.uint8), np.zeros(0))
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_lang / n))])
    sample = rows.where((F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")]).where(F.col("text").isNotNull())

    def count(batches):
        for batch in batches:
            raw, names = texts(batch.column("text")), np.array(batch.column("lang").to_pylist(), object)
            for name in dict.fromkeys(names):
                own = [raw[i] for i in np.flatnonzero(names == name)]
                for at, to in runs_by_size([len(x) for x in own], CHUNK):
                    data = np.frombuffer(b"".join(map(folded, own[at:to])), np.uint8)
                    for n in ORDERS:
                        g, c = np.unique(grams(data, n), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array([n] * len(g), pa.int64()), pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "n", "gram", "c"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, n long, gram long, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    total = counts.groupBy("lang", "n").agg(F.sum("c").alias("t"))
    common = counts.join(F.broadcast(total), ["lang", "n"]).where(F.col("c") >= floor * F.col("t"))
    got = common.select("lang", "gram", (F.col("c") / F.col("t")).alias("p")).toPandas()
    langs = tuple(sorted(sizes, key=lambda x: (-sizes[x], x)))
    got = got[got.p >= ratio * got.groupby("gram").p.transform("max")] if len(got) else got
    most = int(got.groupby("lang").size().max()) if len(got) else 1
    bits = max(12, int(np.ceil(np.log2(16 * most))))
    planes = np.zeros(((len(langs) + 7) // 8, 1 << bits), np.uint8)
    fpr = np.zeros(len(langs))
    for i, name in enumerate(langs):
        g = got[got.lang == name].gram.to_numpy().astype(np.uint64)
        for p in positions(g, bits):
            planes[i // 8, p] |= np.uint8(1 << i % 8)
        fpr[i] = np.mean((planes[i // 8] >> np.uint8(i % 8)) & 1) ** len(HASHES)
    return LanguageModel(langs, planes, fpr)


def counts_by_language(model: LanguageModel, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text its n-grams found in each language's filter, and its n-grams."""
    bits = int(model.planes.shape[1]).bit_length() - 1
    of_bit = (np.arange(256)[:, None] >> np.arange(8)) & 1
    hits, total = np.zeros((len(raw), 8 * len(model.planes)), np.int64), np.zeros(len(raw), np.int64)
    for at, to in runs_by_size([len(x) for x in raw], CHUNK):
        part = [folded(x) for x in raw[at:to]]
        sizes = np.array([len(x) for x in part])
        data = np.frombuffer(b"".join(part), np.uint8)
        doc = np.repeat(np.arange(len(part)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes up to the text's end
        for n in ORDERS:
            gram = grams(data, n)
            own = left[: len(gram)] >= n  # n-grams that run into the next text don't count
            places = positions(gram[own], bits)
            d = doc[: len(gram)][own]
            total[at:to] += np.bincount(d, minlength=len(part))
            for i, plane in enumerate(model.planes):
                mask = plane[places[0]]
                for p in places[1:]:
                    mask = mask & plane[p]
                by_mask = np.bincount(d * 256 + mask, minlength=256 * len(part)).reshape(-1, 256)
                hits[at:to, 8 * i : 8 * i + 8] += by_mask @ of_bit
    return hits[:, : len(model.langs)], total


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def identify(df: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "") -> DataFrame:
    """df with lang_pred, score (the winner's share of the text's n-grams, 0 to 1) and n_grams.

    Null, empty and letterless texts get `und` and 0, as does every text if no language is known.
    Ties go to the language with more training texts. Repeated rows get equal results; columns of
    df named like the results are replaced; a prefix for their names avoids that."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def make(batch):
            raw = texts(batch.column(text))
            if not m.langs:
                return [pa.array([None] * len(raw), pa.string()), pa.array([0.0] * len(raw), pa.float64()), pa.array([0] * len(raw), pa.int64())]
            hits, total = counts_by_language(m, raw)
            true = np.clip((hits - total[:, None] * m.fpr) / (1 - m.fpr), 0, None)
            best = np.argmax(true, axis=1)
            score = np.clip(true[np.arange(len(raw)), best] / np.maximum(total, 1), 0, 1)
            return [pa.array([m.langs[i] for i in best], pa.string()), pa.array(score, pa.float64()), pa.array(total, pa.int64())]

        return make

    out = append_arrow(df, [StructField(f"{prefix}lang_pred", StringType()), StructField(f"{prefix}score", DoubleType()), StructField(f"{prefix}n_grams", LongType())], start, text)
    known = has_letter(text) & F.col(f"{prefix}lang_pred").isNotNull()
    return out.withColumns({f"{prefix}lang_pred": F.when(known, F.col(f"{prefix}lang_pred")).otherwise(UNDETERMINED), f"{prefix}score": F.when(known, F.col(f"{prefix}score")).otherwise(0.0)})
