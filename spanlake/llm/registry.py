"""The thin queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, hard_negatives, language_id, media, mixing, quality_rules, resampling, sharding, simhash, token_files, toxicity, whitening
from .common import held_out, new_path, table

#: A vocabulary file outside the repository; a parameter of the operators.
VOCABULARY = "word_bpe_49k.json"


#: Shards that op1 deals documents into.
SHARDS = 24


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.place(table(spark, sf_dir, "documents"), SHARDS)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.describe(media.store(table(spark, sf_dir, "documents")))
    last = F.element_at("keyframes", -1)
    feature = F.format_string("%s;%d samples;%.2f s;%d keyframes;last at %d+%d", F.trim("codec"), "n_samples", "seconds", F.size("keyframes"), last["offset"], last["length"])
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "codec", "seconds", "keyframes")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = [F.col(f"s.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *base, "base_failed", "kept", "reason")


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return resampling.resample(table(spark, sf_dir, "documents"), good)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda d: d["shard"]).alias("shards"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token_files")
    token_files.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), path)
    return token_files.read_files(spark.read.parquet(path))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hits = F.col("hits")
    return found.select("doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"), F.size(hits["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"), (hits["n_hit"] > 0).alias("contaminated"))


OP11_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), starts AS (
  SELECT item, w, unnest(range(1, greatest(len(w) - 9, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM item_words
), windows AS (
  SELECT DISTINCT item, array_to_string(w[i:i+9], ' ') AS words, least(len(w), 10) AS width FROM starts
), doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), places AS (
  SELECT r, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM doc_words, (SELECT DISTINCT width FROM windows)
), hits AS (
  SELECT p.r, p.i, p.width, x.item FROM (SELECT r, i, width, array_to_string(w[i:i+width-1], ' ') AS words FROM places) p JOIN windows x USING (width, words)
), counted AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + width)) AS place FROM (SELECT DISTINCT r, i, width FROM hits)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc_words LEFT JOIN counted USING (r) LEFT JOIN named USING (r)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("id") % 50 == 0)


OP12_SQL = """
WITH vectors AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS alike, r.vec_id, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fit = whitening.whiten(table(spark, sf_dir, "embeddings"))
    error = whitening.identity_error(rows) if fit else 0.0
    explained = F.array(*map(F.lit, fit.explained.tolist())) if fit else F.array(F.lit(0.0))
    each = rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return each.select(
        "vec_id", (F.col("pos") + 1).alias("component"), F.lit(fit.n if fit else 0).cast("long").alias("n"), F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened", F.element_at(explained, F.col("pos") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_virtual_slots, op2_media, op3_quality_rules, op4_importance_resampling, op5_mixing, op6_bpe, op7_toxicity, op8_simhash, op9_language_id, op10_token_files, op11_decontamination, op12_hard_negatives, op13_whitening]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_decontamination": OP11_SQL, "op12_hard_negatives": OP12_SQL}
