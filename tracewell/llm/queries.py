"""One thin query for each operator over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bitsliced, bpe, ctw, decontam, hardneg, html, langid, linededup, pii, secrets, sharding, simhash, whitening
from tracewell.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(parts: Column, sep: str) -> Column:
    return F.sha2(F.array_join(parts, sep), 256)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 3) != 1))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_grams")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.clusters(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return bitsliced.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, tokens = ctw.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)
    return scores.select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    out = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.col("ids").cast("array<string>"), " ").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def n_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs)).drop("text")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *[n_of(k) for k in ("assign", "access", "hex")], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), n_of("random"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[n_of(k) for k in pii.BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontam.n_hit(F.col("runs"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha(F.col("items"), ",").alias("items_sha256"), (hit > 0).alias("contaminated"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    maps = linededup.materialise(linededup.keep_bitmaps(docs), "keep_bitmaps")
    kept = linededup.kept_text(F.col("text"), F.col("keep"))
    return docs.join(maps.hint("merge"), "doc_id", "left").select("doc_id", linededup.n_lines(F.col("text")).alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hardneg.mine(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op12_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 16)


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    models = whitening.fit(vectors)
    error = whitening.identity_error(vectors, models)
    rows = whitening.whiten(vectors, models)
    each = rows.select("vec_id", "n", F.col("deviation").alias("deviation_exact"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("pos", "c"))
    return each.select("vec_id", (F.col("pos") + 1).alias("component"), "n", F.expr("try_cast(deviation_exact AS long)").alias("deviation"), "c.whitened", "c.explained", F.lit(error).alias("identity_error"), "deviation_exact")


OP4_SQL = r"""
WITH v AS (SELECT vec_id, LIST_TRANSFORM(embedding, lambda x: CAST(FLOOR(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(LIST_SUM(LIST_TRANSFORM(RANGE(1, LEN(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP11_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  LIST_TRANSFORM(embedding, lambda x: CAST(FLOOR(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND label IS NOT NULL AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.label = a.label AS same, c.vec_id,
             CAST(LIST_SUM(LIST_TRANSFORM(RANGE(1, LEN(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(ROW_NUMBER() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP10_SQL = r"""
WITH l AS (SELECT doc_id, UNNEST(ls) AS line, UNNEST(RANGE(LEN(ls))) AS pos
           FROM (SELECT doc_id, STRING_SPLIT(COALESCE(text, ''), CHR(10)) AS ls FROM documents)),
k AS (SELECT *, TRANSLATE(TRIM(line, ' ' || CHR(9) || CHR(10) || CHR(11) || CHR(12) || CHR(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, MAX(doc_id) AS keeper FROM k WHERE LENGTH(key) >= 20 GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, COALESCE(k.doc_id <> d.keeper, FALSE) AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (gone) AS n_dropped,
       SHA256(COALESCE(STRING_AGG(line, CHR(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_language_id, op2_simhash, op3_html, op4_top_k, op5_lm_score, op6_bpe, op7_secrets, op8_decontaminate, op9_pii, op10_line_dedup, op11_hard_negatives, op12_shard, op13_whiten)}


def oracle_sql() -> dict[str, str]:
    return {"op4_top_k": OP4_SQL, "op10_line_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL}
