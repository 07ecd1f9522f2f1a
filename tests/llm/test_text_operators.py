"""Operators on `documents` against brute-force versions, on the small tables and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontam, langid, linededup, queries, simhash

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LICENCE = "Permission is hereby granted, free of charge, to any person"
ODD = [
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, "   \n\t", None, "s", 5),
    (4, f"alpha beta\n{LICENCE}\r\nend", "en", None, 9),
    (5, f"  {LICENCE.upper()}\t\n\nx", "en", "s", 9),
    (6, f"{LICENCE}\n{LICENCE}\n", "fr", "s", 9),
    (7, f"é {LICENCE}\n{LICENCE}", "en", "s", 9),
    (8, "word " * 30_000, "en", "s", 150_000),
    (9, "alpha beta\nPermission", "en", "s", 20),
    (10, "日本語 テキスト 🎉 é ||| \x0b\x0c 12345", "ja", "s", 20),
    (11, "日本語 テキスト 🎉 é ||| \x0b\x0c 12345", "ja", "s", 20),
    (-5, "a b", "en", "s", 3),
    (12, "A  B", "en", "s", 3),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ODD, DOCS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, " , "), (4, "alpha BETA"), (5, "word " * 12)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


@pytest.fixture(params=["small", "odd"])
def tables(request, sf_dir, odd_dir):
    return sf_dir if request.param == "small" else odd_dir


def rows_of(spark, d, name="documents"):
    return [r.asDict() for r in spark.read.parquet(f"{d}/{name}.parquet").collect()]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def got(df, key="doc_id"):
    out = {r[key]: r.asDict() for r in df.collect()}
    assert len(out) == df.count()
    return out


def simple_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(ASCII)) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = Counter(xxhash.xxh64_intdigest(g.encode(), 42) for g in grams)
    return sum(1 << b for b in range(64) if 2 * sum(c for x, c in h.items() if x >> b & 1) > len(grams))


def simple_components(fps):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d in ids}


def test_simhash(spark, tables):
    fps = {r["doc_id"]: simple_fingerprint(r["text"]) for r in rows_of(spark, tables)}
    want = simple_components(fps)
    out = got(queries.op2_simhash(spark, tables))
    assert {d: (int(r["fingerprint"], 16), r["component_id"]) for d, r in out.items()} == {d: (fps[d], want[d]) for d in fps}


@pytest.mark.parametrize("bucket", [0, 4, 32])
def test_links_of_crowded_buckets(spark, monkeypatch, bucket):
    """Chains, hubs and a ball of near fingerprints: components as by all pairs, at every bucket size."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    base = 0x0123456789ABCDEF
    fps = {0, base} | {base ^ 1 << i for i in range(40)} | {base ^ (1 << i) ^ (1 << j) ^ (1 << 50) for i in range(6) for j in range(i)} | {(0xFFFF << 48) ^ ((1 << n) - 1) for n in range(0, 48, 2)} | {(0xFFFF << 48) ^ ((1 << n) - 1) ^ (0xFF << 50) for n in range(0, 48, 3)}
    ids = dict(enumerate(sorted(fps)))
    want = simple_components(ids)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    star = {r["u"] & (1 << 64) - 1: r["v"] & (1 << 64) - 1 for r in simhash.stars(simhash.links(df)).collect()}
    of = {f: star.get(f, f) for f in fps}
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(of) == groups({f: want[i] for i, f in ids.items()})


def test_near_dedup_keeps_one_row(spark):
    rows = [*ODD, ODD[3], (None, "a b", "en", "s", 3), (None, "a b", "en", "s", 3)]
    kept = simhash.near_dedup(spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("own")))
    fps = {r[0]: simple_fingerprint(r[1]) for r in ODD}
    want = {d for d, c in simple_components(fps).items() if d == c}
    got_ids = [r["doc_id"] for r in kept.collect()]
    ids = sorted(x for x in got_ids if x is not None)
    assert ids == sorted(want) and got_ids.count(None) == 2 and kept.columns[-1] == "fp"


def test_bpe(spark, tables):
    ranks = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = got(queries.op6_bpe(spark, tables))
    for r in rows_of(spark, tables):
        ids, o = enc.encode_ordinary(r["text"] or ""), out[r["doc_id"]]
        assert (o["n_tokens"], o["ids_sha256"], o["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(r["text"] or ""))


RANKS = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
WHOLE = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=RANKS.ranks, special_tokens={})


def test_bpe_replay_of_odd_words():
    draw = random.Random(3)
    words = ["", "a", "aaaaaaaaaaaaa", "  " * 50, "theretherethere", "ééé日本", "x" * 3000, "-=" * 400, "\U0001f389" * 9]
    words += ["".join(draw.choices("abcnst é", k=draw.randint(1, 40))) for _ in range(3000)]
    want = [WHOLE.encode_ordinary(w) for w in words]
    for replay in (bpe.replay, lambda *x: bpe.replay(*x, singly=True)):
        flat, sizes = replay([w.encode() for w in words], RANKS)
        assert flat.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]


def test_bpe_replay_where_a_merge_opens_a_lower_rank():
    parts = ["a", "b", "c", "d", "bc", "abcd", "cd", "ab", "abab", "ba"]
    draw = random.Random(5)
    for seed in range(60):
        order = draw.sample(parts[4:], 6)
        ranks = {t.encode(): i for i, t in enumerate(parts[:4] + order)}
        enc = tiktoken.Encoding(f"own{seed}", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        words = ["".join(draw.choices("abcd", k=draw.randint(1, 12))) for _ in range(50)]
        flat, sizes = bpe.replay([w.encode() for w in words], bpe.vocabulary(ranks, ""))
        want = [enc.encode_ordinary(w) for w in words]
        assert (flat.tolist(), sizes.tolist()) == ([i for x in want for i in x], [len(x) for x in want])


def test_bpe_merge_touches_only_its_places_and_their_neighbours():
    state = bpe.Words([b"other", b"the", b"xyz", b"bathe"], RANKS)
    while state.queue:
        before = [x.copy() for x in (state.token, state.pair, state.alive, state.after, state.before)]
        rank = state.queue[0]
        places = np.sort(np.concatenate(state.index[rank]))
        places = places[state.pair[places] == rank]
        near = {*places.tolist(), *state.after[places].tolist(), *state.before[places].tolist(), *state.after[state.after[places]].tolist()}
        state.merge_next(False)
        for old, new in zip(before, (state.token, state.pair, state.alive, state.after, state.before), strict=True):
            assert {*np.flatnonzero(old != new).tolist()} <= near
        assert rank not in state.index


def test_bpe_known_pretokens_may_be_forgotten(monkeypatch):
    texts = [f"word{i % 7} and the rest {i}" for i in range(40)]
    whole = bpe.Encoder(RANKS).encode(texts)
    monkeypatch.setattr(bpe, "HELD", 8)
    parts = bpe.Encoder(RANKS)
    got = [parts.encode(texts[i : i + 3]) for i in range(0, 40, 3)]
    assert np.concatenate([g[0] for g in got]).tolist() == whole[0].tolist() and np.concatenate([g[1] for g in got]).tolist() == whole[1].tolist()


def test_bpe_columns_repeats_unknown_ids_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (2, None, 6)], "doc_id long, text string, ids long")
    df = df.withColumn("a.b", F.lit(7))
    out = bpe.encode(df, RANKS, decoded="back").collect()
    assert [bytes(r["back"]) for r in out] == [b"a b", b"a b", b""] and out[0]["ids"] == out[1]["ids"] == WHOLE.encode_ordinary("a") + WHOLE.encode_ordinary(" b") and out[2]["ids"] == []
    assert all(r["a.b"] == 7 for r in out)
    assert bpe.encode(df.limit(0), RANKS).count() == 0 and bpe.decode(bpe.encode(df.limit(0), RANKS), RANKS).count() == 0
    odd = spark.createDataFrame([([64, None, 10**7, -1, 65],), (None,), ([],)], "ids array<int>").withColumn("decoded", F.lit(1))
    assert [bytes(r["decoded"]).decode() for r in bpe.decode(odd, RANKS).collect()] == ["a\ufffd\ufffd\ufffdb", "", ""]


def simple_scan(text, items):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(ASCII))
    hit, found = set(), set()
    for item, body in items:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (body or "").translate(ASCII))
        for i in range(max(1, len(w) - 9)) if w else ():
            win = w[i : i + 10]
            for j in range(len(words) - len(win) + 1):
                if words[j : j + len(win)] == win:
                    hit |= {*range(j, j + len(win))}
                    found.add(str(item))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def test_decontamination(spark, tables):
    items = [(r["item_id"], r["text"]) for r in rows_of(spark, tables, "benchmark")]
    out = got(queries.op8_decontaminate(spark, tables))
    seen = 0
    for r in rows_of(spark, tables):
        if len(r["text"] or "") > 20_000 and r["doc_id"] != 8:
            continue
        o = out[r["doc_id"]]
        want = simple_scan(r["text"], items) if r["doc_id"] != 8 or tables.endswith("sf0.001") else (30_000, 30_000, 1, sha("5"), True)
        assert (o["n_words"], o["n_hit"], o["n_items"], o["items_sha256"], o["contaminated"]) == want
        seen += o["contaminated"]
    assert seen


def test_decontamination_in_groups_and_offsets(spark, monkeypatch, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = got(decontam.scan(docs, bench))
    monkeypatch.setattr(decontam, "GROUP_BYTES", 1500)
    assert got(decontam.scan(docs, bench)) == one
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for d, r in one.items():
        for run in r["runs"]:
            cut = text[d][run["start"] : run["end"]]
            assert len(decontam.words_of(cut.encode())) == run["last_word"] - run["first_word"] + 1
    empty = got(decontam.scan(docs, bench.limit(0)))
    assert all(r["runs"] == [] and r["items"] == [] for r in empty.values())


def test_line_dedup(spark, tables):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tables}/documents.parquet{'' if tables.endswith('0.001') else '/*.parquet'}')")
    want = {r[0]: r[1:] for r in con.execute(queries.OP10_SQL).fetchall()}
    out = got(queries.op10_line_dedup(spark, tables))
    assert {d: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for d, r in out.items()} == want
    assert any(x[1] for x in want.values())


def test_line_dedup_of_repeated_and_null_ids(spark):
    rows = [*ODD, ODD[3], (None, LICENCE, "en", "s", 1)]
    out = linededup.dedup_lines(spark.createDataFrame(rows, DOCS).withColumn("keep", F.lit(1)))
    texts = sorted(r["text"] or "" for r in out.where("doc_id = 4").collect())
    assert texts == ["alpha beta\nend"] * 2
    assert out.where("doc_id is null").first()["text"] == LICENCE and out.count() == len(rows)
    assert out.where("doc_id = 1").first()["text"] is None


def test_language_id(spark, sf_dir, odd_dir):
    docs = {r["doc_id"]: r for r in rows_of(spark, sf_dir)}
    out = got(queries.op1_language_id(spark, sf_dir))
    assert out.keys() == docs.keys()
    right = total = 0
    for d, r in out.items():
        held = zlib.crc32(str(d).encode()) % 3 == 1
        assert r["held_out"] == held and 0 <= r["score"] <= 1
        text = docs[d]["text"] or ""
        if not any(c.isalpha() for c in text):
            assert r["lang_pred"] == "und" and r["score"] == 0
        elif held and len(text) > 100:
            total += 1
            right += r["lang_pred"] == docs[d]["lang"]
    assert total and right >= 0.95 * total
    odd = got(queries.op1_language_id(spark, odd_dir))
    assert [odd[d]["lang_pred"] for d in (1, 2, 3)] == ["und"] * 3


def test_language_id_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9)], DOCS)
    model = langid.fit(docs)
    assert langid.identify(docs, model).select("lang_pred", "score").collect() == [("und", 0.0)]
    assert langid.identify(docs.limit(0), model).count() == 0
    clash = langid.identify(docs.withColumn("score", F.lit("x")), model)
    assert clash.columns.count("score") == 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for f in (queries.op1_language_id, queries.op2_simhash, queries.op6_bpe, queries.op8_decontaminate, queries.op10_line_dedup):
        assert f(spark, str(tmp_path)).count() == 0
