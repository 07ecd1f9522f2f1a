"""corpus_pipeline.run against plain versions of its five stages."""

import random
from collections import defaultdict

import public_tokenizers
import tiktoken
from test_neardup import components

import corpus_pipeline
from tracewell.llm import bpe, stages

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOOTER = "All rights in this text belong to Nobody in particular"
PASSAGE = "which of these twelve invented metals would melt first in warm rain"
GREEK = "ξψφθωλπσδ γκλμνξοπρς τυφχψωαβγ δεζηθικ λμνξοπρστυ φχψω " * 5


def fixture():
    """Two invented languages, repeated lines, exact and near copies, a benchmark passage and rows to be rejected."""
    r, texts = random.Random(5), []
    words = {k: ["".join(r.choice(letters) for _ in range(r.randrange(3, 8))) for _ in range(400)] for k, letters in (("aa", "abcdefghijklm"), ("bb", "nopqrstuvwxyz"))}
    for lang, vocabulary in words.items():
        for _ in range(20):
            texts.append((lang, "\n".join(" ".join(r.choice(vocabulary) for _ in range(12)) for _ in range(r.randrange(4, 9)))))
    texts += [texts[3], (texts[30][0], texts[30][1].upper())]
    texts += [(lang, text.replace(text.split()[20], "changed", 1)) for lang, text in texts[8:12]]
    texts += [(None, text + f"\n  {FOOTER}\t\n{n}") for n, (_, text) in enumerate(texts[12:16])]
    texts += [("aa", f"{texts[16][1]}\n{PASSAGE.upper()}"), ("bb", texts[25][1] + " hello world again")]
    texts += [(None, None), ("aa", ""), ("bb", "12 345 ... 67"), (None, GREEK)]
    r.shuffle(texts)
    return [(i, text, lang, "s", len(text or "")) for i, (lang, text) in enumerate(texts)]


def windows(text):
    words = text.split()
    return {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))}


def expected(rows, items):
    docs = {i: text for i, text, *_ in rows if text and text != GREEK and any(c.isalpha() for c in text)}
    holders = defaultdict(set)
    for i, text in docs.items():
        for line in text.split("\n"):
            holders[line.strip().lower()].add(i)
    gone = lambda i, key: len(key) >= 20 and len(holders[key]) >= 3 and i != max(holders[key])
    docs = {i: "\n".join(x for x in text.split("\n") if not gone(i, x.strip().lower())) for i, text in docs.items()}
    docs = {i: docs[i] for i in set(components([(i, text, None) for i, text in docs.items()]).values())}
    bad = set().union(*(windows(x) for x in items if len(x.split()) >= 5))
    docs = {i: text for i, text in docs.items() if not windows(text.lower()) & bad}
    ranks = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {i: (enc.encode_ordinary(text), text) for i, text in docs.items()}


def test_run_is_the_plain_version(spark, tmp_path):
    rows, items = fixture(), [PASSAGE, "hello world again"]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = expected(rows, items)
    assert {r.doc_id: (r.ids, r.text) for r in out} == want
    assert all(r.n_tokens == len(r.ids) for r in out) and len(out) == len(want)
    assert 30 < len(want) < len(rows) - 8


def test_run_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_columns_of_any_names(spark, sf_dir):
    """Also those that are named like what a stage works with."""
    extra = "language_id_score double, language_id_lang_pred string, decontam_items string, decontam_n_words int"
    rows = [(1, "the cat sat on the mat and the dog ran", "en", "s", 38, 0.5, "x", "y", 7), (2, None, None, "s", None, 1.5, None, "z", 8)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    kept = stages.language_id(spark, docs, sf_dir)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == rows[:1]
    clean = stages.decontaminate(spark, docs, sf_dir)
    assert clean.columns == docs.columns and sorted(tuple(r)[5:] for r in clean.collect()) == [r[5:] for r in rows]
