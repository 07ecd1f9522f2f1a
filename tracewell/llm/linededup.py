"""Line deduplication over a corpus: keep bitmaps, by DataFrame functions alone.

Every line of `min_chars` code points or more becomes a row (128-bit hash of its key, doc_id, line
number). Hashes are uniform, so their ranges are cut by value (the upper bits), and a range is cut
again by SALTS over documents: a hash that a third of all documents hold is spread over as many cells.
A cell is sorted by hash, then document from the largest down, then line, and streamed: each row
learns how many documents of its cell had the hash so far. The first `min_docs` documents of each hash
and cell are all that has to meet to tell whether so many hold it and which one keeps it. The result
is one bitmap per document, as a map from word number to 64 keep bits that leaves out the words with
all lines kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import UPPER, fresh, materialise, quoted

SPACE = " \t\n\x0b\x0c\r"
SEED = 7
#: Cells by document that a range of hashes is cut into, and ranges of hashes.
SALTS, RANGES = 16, 1 << 10


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def n_lines(text: Column) -> Column:
    full = F.coalesce(text, F.lit(""))
    return (F.length(full) - F.length(F.replace(full, F.lit("\n"), F.lit(""))) + 1).cast("long")


def salt(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")


def occurrences(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """h1, h2, doc_id, pos, nth: a row per line, stored cell by cell in order; nth numbers the documents
    of a hash within its cell, from the largest down."""
    lines = docs.where(quoted(doc_id).isNotNull()).select(quoted(doc_id).alias("doc_id"), F.posexplode(lines_of(F.translate(quoted(text), UPPER, UPPER.lower()))).alias("pos", "line"))
    keys = lines.select("doc_id", "pos", F.btrim("line", F.lit(SPACE)).alias("key")).where(F.length("key") >= min_chars)
    hashed = keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(SEED), "key").alias("h2"), "doc_id", "pos")
    cell = ["range", "salt"]
    dealt = hashed.withColumns({"range": F.shiftrightunsigned("h1", 64 - RANGES.bit_length() + 1), "salt": salt("doc_id")}).repartition(*cell)
    order = ["h1", "h2", F.desc("doc_id")]
    nth = F.dense_rank().over(Window.partitionBy(*cell, "h1", "h2").orderBy(F.desc("doc_id")))
    return materialise(dealt.sortWithinPartitions(*cell, *order, "pos").select("h1", "h2", "doc_id", "pos", nth.alias("nth")), "line_hashes")


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_dropped, keep for each document that loses lines; documents without a row keep all.

    A key is the line with white space stripped at both ends and A-Z lower-cased; one found in
    min_docs documents stays only in the largest doc_id. Null and empty texts are one empty line.
    Rows without doc_id lose nothing and don't count. Rows that repeat a doc_id are one document:
    a bitmap holds for line numbers of that doc_id. No rows: no bitmaps."""
    rows = occurrences(docs, doc_id, text, min_chars)
    firsts = rows.where(F.col("nth") <= min_docs).groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    often = firsts.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # The keepers go to every cell of their hash, so that no cell is larger for a hash that many hold.
    keepers = materialise(often.select("h1", "h2", "keeper"), "line_keepers").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.withColumn("salt", salt("doc_id")).join(keepers, ["h1", "h2", "salt"])
    dropped = met.where(F.col("doc_id") != F.col("keeper")).select("doc_id", "pos")
    words = dropped.groupBy("doc_id", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc_id").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits")))).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The text without the lines whose keep bit is 0; a null text with no bitmap is empty."""
    stays = lambda line, i: F.coalesce(F.getbit(F.element_at(keep, F.floor(i / 64).cast("int")), (i % 64).cast("int")), F.lit(1)) == 1
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(lines_of(text), stays), "\n"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """docs with the repeated lines taken out of text, as keep_bitmaps has it; a null text stays null.

    Rows that repeat a doc_id are all kept, each by its document's bitmap. Columns of docs may have any
    names and keep their order. No rows: no rows."""
    doc, keep = fresh(docs, "doc"), fresh(docs, "keep")
    maps = materialise(keep_bitmaps(docs, doc_id, text, **limits), "keep_bitmaps").select(F.col("doc_id").alias(doc), F.col("keep").alias(keep))
    # Bitmaps grow with the corpus: no broadcast at any size.
    out = docs.join(maps.hint("merge"), quoted(doc_id) == F.col(doc), "left")
    left = F.when(quoted(text).isNotNull(), kept_text(quoted(text), F.col(keep))).alias(text)
    return out.select(*[left if c == text else quoted(c) for c in docs.columns])
