"""Context-tree weighting against a plain recursion over trees, and the base score against its formula."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import ctw, queries

DOCS = "doc_id long, text string"
ROWS = [(0, "the cat sat on the mat"), (1, "The cat  sat\non the hat"), (2, None), (3, ""), (4, "zebra the Ünïcode cat"), (5, "a" * 5000), (6, "the cat"), (7, "the the the the"), (8, " \t "), (9, "mat hat cat")]


def stream(text):
    words = (text or "").encode().lower().split()
    return words, b" ".join(words) + b"\xff"


def simple_model(texts):
    """log10 probability of a byte in a context, by recursion."""
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        s = b"\xff" * ctw.DEPTH + stream(t)[1]
        for i in range(ctw.DEPTH, len(s)):
            for d in range(ctw.DEPTH + 1):
                for k in range(8):
                    counts[s[i - d : i], 1 << k | s[i] >> 8 - k][s[i] >> 7 - k & 1] += 1
    kids = defaultdict(set)
    for c, p in counts:
        if c:
            kids[c[1:], p].add(c)
    lg = math.lgamma
    own = {k: lg(a + 0.5) + lg(b + 0.5) - math.log(math.pi) - lg(a + b + 1) for k, (a, b) in counts.items()}
    weighted, stop = {}, {}
    for c, p in sorted(counts, key=lambda k: -len(k[0])):
        if len(c) == ctw.DEPTH:
            weighted[c, p], stop[c, p] = own[c, p], 1.0
        else:
            below = sum(weighted[x, p] for x in kids[c, p])
            hi, lo = max(own[c, p], below), min(own[c, p], below)
            weighted[c, p] = math.log(0.5) + hi + math.log1p(math.exp(lo - hi))
            stop[c, p] = 1 / (1 + math.exp(min(700, below - own[c, p])))

    def one(context, p, d=0):
        c = context[len(context) - d :]
        if (c, p) not in counts:
            return None
        a, b = counts[c, p]
        kt = (b + 0.5) / (a + b + 1)
        deeper = one(context, p, d + 1) if d < ctw.DEPTH else kt
        return stop[c, p] * kt + (1 - stop[c, p]) * (kt if deeper is None else deeper)

    def log10(context, byte):
        out = 0
        for k in range(8):
            q = one(context, 1 << k | byte >> 8 - k)
            q = 0.5 if q is None else q
            out += math.log10(q if byte >> 7 - k & 1 else 1 - q)
        return out

    return log10


def simple_scores(rows, trains):
    log10 = simple_model([t for i, t in rows if trains(i)])
    c = Counter()
    for i, t in rows:
        if trains(i):
            c.update([*stream(t)[0], None])
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        words, s = stream(t)
        own, padded = [*words, None], b"\xff" * ctw.DEPTH + s
        out[i] = (len(own), sum(w in c for w in own), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), sum(log10(padded[j : j + ctw.DEPTH], x) for j, x in enumerate(s)))
    return out, n


@pytest.mark.parametrize("block, salt", [(30, 2), (1 << 23, 512)])
def test_against_recursion(spark, tmp_path, monkeypatch, block, salt):
    monkeypatch.setattr(ctw, "BLOCK", block)
    monkeypatch.setattr(ctw, "SALT", salt)
    spark.createDataFrame(ROWS, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want, n = simple_scores(ROWS, lambda i: zlib.crc32(str(i).encode()) % 5 != 1)
    got = queries.op5_lm_score(spark, str(tmp_path)).collect()
    assert len(got) == len(ROWS) and any(r["held_out"] for r in got)
    for r in got:
        a = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (a[0], a[1], n)
        assert r["base_score"] == pytest.approx(a[2], rel=1e-9) and r["score"] == pytest.approx(a[3], rel=1e-6)


def test_predictions_sum_to_one():
    log10 = simple_model([t for _, t in ROWS[:5]])
    for context in (b"\xff" * ctw.DEPTH, b"the cat"[-ctw.DEPTH :], b"zzzzzzz"[: ctw.DEPTH]):
        assert sum(10 ** log10(context, x) for x in range(256)) == pytest.approx(1)


def test_no_training_rows_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, None)], DOCS).withColumn("score", F.lit("own"))
    scores, n = ctw.score(df, F.lit(None).cast("boolean"))
    rows = scores.collect()
    assert n == 0 and sorted((r["doc_id"] or 0, r["n_known"], round(r["score"] / math.log10(0.5))) for r in rows) == [(0, 0, 8), (1, 0, 24), (1, 0, 24)]
    assert ctw.score(df.limit(0), F.lit(True))[0].count() == 0


def test_beats_single_bytes_on_held_out_texts(spark, sf_dir):
    """On 200 documents: a shorter code than an ideal one for bytes without context."""
    bytes_of = Counter(x for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for x in stream(r["text"])[1])
    n = sum(bytes_of.values())
    ideal = sum(c * math.log10(c / n) for c in bytes_of.values())
    assert queries.op5_lm_score(spark, sf_dir).where("held_out").agg(F.sum("score")).first()[0] > 0.8 * ideal


def test_each_distinct_gram_is_searched_once(monkeypatch):
    """Scores are looked up by distinct grams in rising order, and are those of a plain search; nothing hashes grams one by one."""
    streams = [b"the cat sat on the mat " * 40, b"", b"zebra" * 30]
    plain = sorted({g for s in streams for g in ctw.grams_of([s])[0].tolist()})
    monkeypatch.setattr(np, "unique", None)
    known = ctw.distinct_grams(streams)
    assert known.tolist() == plain
    grams, values = ctw.grams_of(streams)[0], np.arange(len(known)) / 7
    asked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v: asked.append(v) or search(a, v))
    assert ctw.looked_up(grams, known, values).tolist() == [plain.index(g) / 7 for g in grams.tolist()]
    assert [len(v) for v in asked] == [len(known)] and (np.diff(asked[0]) > 0).all()
    none = np.zeros(0, np.int64)
    assert len(ctw.distinct(none)) == len(ctw.looked_up(none, known, values)) == 0
