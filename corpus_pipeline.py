"""A training-data pipeline over documents: each stage calls one operator of spanlake.llm.

Language ID drops documents whose language is rejected, quality rules drop
those that a learned rule rejects, SimHash keeps one document of each group of
near-duplicates (five-word shingles, similarity of about 0.8 or more), mixing
draws the sources to their targets, and BPE encodes what was drawn.

Cases are those of the operators: null, empty and letterless texts go with the
first stage; a null doc_id, source or lang keeps its row; rows that share a
doc_id with other texts are judged each on its own, and rows that repeat wholly
are copies; extra columns pass through all stages but the last; empty tables
give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanlake.llm import bpe, language_id, mixing, quality_rules, simhash
from spanlake.llm.common import materialize, table


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.fit(docs))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_languages),
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: Learned models and seeded draws are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
