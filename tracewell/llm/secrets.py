"""Secret scan: fixed patterns, and character Markov models for strings that follow no pattern.

Two first-order models give the probability of a character after the one before it: one in random
strings, one in ordinary identifiers and words. A string's log-likelihood ratio between them is
summed over its characters; strings with a high enough sum and mean are reported as `random`.

Training is on labelled samples. Ordinary: words of a bounded sample of documents (SAMPLE documents
at most, in expectation, chosen by a hash of doc_id) that no pattern has matched, as they are and
joined in the ways of identifiers. Random: what the patterns matched in that sample, and RANDOM
strings over the alphabets of keys and digests from a seeded generator. Only counts of character
pairs reach the driver, 97 * 97 for each label at most.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tracewell.llm.common import append_arrow

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Texts without these in lower case have no assignment.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: What the models look at.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_CANDIDATE = 16
ALPHABETS = (string.hexdigits[:16], string.hexdigits[:10] + "ABCDEF", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-")
RANDOM, SAMPLE = 20_000, 5_000
#: Nats by which the random model must be ahead, in all and for each character.
LEAST_RATIO, LEAST_MEAN = 12.0, 0.4
SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


@dataclass(frozen=True)
class Models:
    """ratio[a, b]: ln P(b after a | random) - ln P(b after a | ordinary). Codes 0: start, 96: any other."""

    ratio: np.ndarray


def codes(s: str) -> np.ndarray:
    x = np.frombuffer(s.encode("latin-1", "replace"), np.uint8).astype(np.int64) - 31
    return np.concatenate([[0], np.where((x > 0) & (x < 96), x, 96)])


def pair_counts(strings) -> np.ndarray:
    """How often each pair of neighbouring codes is in the strings, each of which begins with code 0."""
    every = [codes(s) for s in strings]
    if not every:
        return np.zeros(97 * 97, np.int64)
    joined = np.concatenate(every)
    pairs = joined[:-1] * 97 + joined[1:]
    ends = np.cumsum([len(c) for c in every])[:-1] - 1  # pairs from one string into the next
    return np.bincount(np.delete(pairs, ends), minlength=97 * 97)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans in code points, by start and then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if max(map(len, text.split()), default=0) >= LEAST_HEX:
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def ordinary_strings(text: str, spans) -> list[str]:
    """Words of eight letters or more outside of spans, and identifiers made of neighbours."""
    rest, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        rest.append(text[at : max(at, a)])
        at = max(at, b)
    words = re.findall(r"[A-Za-z]{3,}", " ".join([*rest, text[at:]]))
    return [w for w in words if len(w) >= 8] + ["_".join(words[i : i + 3]) for i in range(0, len(words), 9)] + ["".join(w.title() for w in words[i : i + 3]) for i in range(3, len(words), 9)] + ["-".join(words[i : i + 3]).lower() for i in range(6, len(words), 9)]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Models:
    """Learns from a sample of docs; without texts, from random strings against even chances."""
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    share = min(1.0, SAMPLE / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30) < share).select("text")

    def count(batches):
        sums = np.zeros((2, 97 * 97), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                spans = base_spans(t)
                sums[0] += pair_counts(ordinary_strings(t, spans))
                sums[1] += pair_counts([re.split(r"[\s:=\"']", t[a:b])[-1] for _, a, b in spans])
        label, pair = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(sums[label, pair])], names=["label", "pair", "n"])

    counts = sample.mapInArrow(count, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((2, 97 * 97))
    for r in counts:
        table[r["label"], r["pair"]] = r["n"]
    draw = random.Random(7)
    table[1] += pair_counts("".join(draw.choices(ALPHABETS[i % len(ALPHABETS)], k=draw.randint(16, 48))) for i in range(RANDOM))
    chance = table.reshape(2, 97, 97) + 0.5
    chance /= chance.sum(2, keepdims=True)
    return Models(np.log(chance[1]) - np.log(chance[0]))


def ratio_of(models: Models, s: str) -> float:
    c = codes(s)
    return float(models.ratio[c[:-1], c[1:]].sum())


def looks_random(models: Models, s: str) -> bool:
    r = ratio_of(models, s)
    return r >= LEAST_RATIO and r >= LEAST_MEAN * len(s)


def all_spans(models: Models, text: str) -> list[tuple[str, int, int]]:
    """Pattern spans, and random strings that touch none of them."""
    out = base_spans(text)
    if max(map(len, text.split()), default=0) >= LEAST_CANDIDATE:
        new = [("random", m.start(), m.end()) for m in CANDIDATE.finditer(text) if looks_random(models, m[0])]
        base, at = sorted((a, b) for _, a, b in out), 0
        reach = 0  # the end of the furthest base span that starts before the candidate's end
        for kind, a, b in new:
            while at < len(base) and base[at][0] < b:
                reach = max(reach, base[at][1])
                at += 1
            if reach <= a:
                out.append((kind, a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(df: DataFrame, models: Models, text: str = "text", out: str = "spans") -> DataFrame:
    """df with the spans of secrets (kind, start, end in code points) of each whole text.

    Null and empty texts have none. Spans are by start, then kind. Repeated rows get equal spans; a
    column of df named like out is replaced. No rows: no rows."""
    shared = df.sparkSession.sparkContext.broadcast(models)

    def start():
        m = shared.value

        def make(batch):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in all_spans(m, t)] if t else [] for t in batch.column(text).to_pylist()]
            return [pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]

        return make

    return append_arrow(df, [StructField(out, ArrayType(SPAN))], start, text)
