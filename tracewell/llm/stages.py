"""The stages of corpus_pipeline.py.

Extra columns pass through (but for tokenize), and their names may be any. Texts of any length count as a whole. No
rows: no rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontam, langid, linededup, neardup
from tracewell.llm.common import quoted

#: A document whose language holds a smaller share of its n-grams is in no known language.
LEAST_SHARE = 0.1
#: A benchmark item of fewer words is no evidence of contamination.
LEAST_WORDS = 5


def own_prefix(docs: DataFrame, name: str) -> str:
    """A beginning that no column of docs has, case ignored."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose best language holds under LEAST_SHARE of
    their n-grams.

    Learns from all labelled documents of its input. With no labelled document nothing is known
    and nothing goes but documents without letters, as null and empty texts are. Repeated rows share
    their fate."""
    own = own_prefix(docs, "language_id_")
    named = langid.identify(docs, langid.fit(docs), prefix=own)
    keep = langid.has_letter("text") & ((F.col(f"{own}lang_pred") == langid.UNDETERMINED) | (F.col(f"{own}score") >= LEAST_SHARE))
    return named.where(keep).select(*[quoted(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; n_chars follows (null for a null text). Documents stay, if
    without text. Rows that repeat a doc_id count as one document and all stay."""
    out, chars = linededup.dedup_lines(docs), F.length("text").cast("long").alias("n_chars")
    return out.select(*[chars if c == "n_chars" else quoted(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate group: texts that are linked
    by a similarity of 0.8 or more of their sets of five-word shingles. Texts without words (null, empty)
    are one group. Rows without doc_id stay; of rows that repeat a doc_id one stays."""
    return neardup.near_dedup(docs).select(*[quoted(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window. Items of under LEAST_WORDS words are left out, as
    they occur in clean text. Null and empty texts hold nothing; repeated rows share their fate."""
    own, items = own_prefix(docs, "decontam_"), decontam.items_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), LEAST_WORDS)
    clean = decontam.scan_rows(docs, items, prefix=own)
    return clean.where(F.size(F.col(f"{own}items")) == 0).select(*[quoted(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that they decode to of each row. Null and empty texts have no
    ids; repeated rows are repeated."""
    vocabulary = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = bpe.encode(docs.select("doc_id", "text"), vocabulary, decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))
