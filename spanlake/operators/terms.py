"""Glossary terms: harvest from corrections, merge, hotwords, prior terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_metadata_text, strip_suffix


def harvest(corrections: DataFrame, suffixes: list[str], verb_ends: list[str], least: int = 2) -> DataFrame:
    """(ws, term, n): in how many corrections (ws, asr, corrected) a new token occurs, its particle stripped.

    Notes that begin with '(', verb endings, short tokens and those with other
    characters than letters and digits don't count.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    stems = lambda c: F.array_distinct(F.transform(words(c), lambda w: strip_suffix(w, suffixes)))
    new = F.array_except(stems(F.col("corrected")), stems(F.col("asr")))
    good = F.filter(new, lambda w: good_term(w, verb_ends, least))
    return corrections.filter(~F.col("corrected").rlike(r"^\s*\(")).select("ws", F.explode(good).alias("term")).groupBy("ws", "term").agg(F.count("*").alias("n"))


def good_term(word: Column, verb_ends: list[str], least: int = 2) -> Column:
    """Whether a word can be a term: letters and digits alone, `least` of them or more, without a verb's ending."""
    return (F.length(word) >= least) & word.rlike(r"^[\p{L}\p{N}]+$") & ~word.rlike("(" + "|".join(verb_ends) + ")$")


def flat_glossary(words: DataFrame, suffixes: list[str], verb_ends: list[str], legacy: str = "legacy") -> DataFrame:
    """(term, ws, n): a flat list of words (word), as glossaries were once kept, gated as harvested terms are: each once, under the legacy mark."""
    stems = words.select(strip_suffix(F.col("word"), suffixes).alias("term")).filter(good_term(F.col("term"), verb_ends)).distinct()
    return stems.select("term", F.lit(legacy).alias("ws"), F.lit(1).cast("long").alias("n"))


def glossary_change(store: DataFrame, merged: DataFrame) -> DataFrame:
    """(added, total): how many terms a merge brought in, and how many there are."""
    new = merged.select("term").distinct().join(store.select("term").distinct().withColumn("old", F.lit(True)), "term", "left")
    return new.agg(F.count_if(F.col("old").isNull()).alias("added"), F.count("*").alias("total"))


def prior_words(text: Column, stop: list[str]) -> Column:
    """Distinct content words of metadata in order of appearance: runs of two or more digits, Latin or Hangul letters, without noise, numbers and stop words (lower case)."""
    words = F.regexp_extract_all(clean_metadata_text(text), F.lit("[0-9A-Za-z가-힣]{2,}"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.rlike("^[0-9]+$") & ~F.lower(w).isin(*stop)))


def merge_glossary(store: DataFrame, harvested: DataFrame, legacy: str = "legacy") -> DataFrame:
    """(term, ws, n): counts of harvested timelines replace their old ones, others stay; the legacy mark goes where a real source exists."""
    renewed = harvested.select("ws").distinct()
    kept = store.join(renewed, "ws", "left_anti").unionByName(harvested.select("ws", "term", "n"))
    real = kept.filter(F.col("ws") != legacy).select("term").distinct().withColumn("real", F.lit(True))
    return kept.join(real, "term", "left").filter((F.col("ws") != legacy) | F.col("real").isNull()).select("term", "ws", "n")


def hotwords(glossary: DataFrame, cap: int = 50, legacy: str = "legacy") -> DataFrame:
    """(place, term): the `cap` terms of most sources, then counts, then by name; place 1 is the lowest of them, as lists are emitted."""
    each = glossary.groupBy("term").agg(F.count_distinct(F.when(F.col("ws") != legacy, F.col("ws"))).alias("sources"), F.sum("n").alias("n"))
    best = each.orderBy(F.desc("sources"), F.desc("n"), "term").limit(cap)
    return best.select(F.row_number().over(Window.orderBy("sources", "n", F.desc("term"))).cast("long").alias("place"), "term")


def prior_terms(fields: DataFrame, quotas: dict[str, int], order: list[str], cap: int = 12) -> DataFrame:
    """(ws, term, field): up to `cap` terms of a video from its fields (ws, field, tokens: array), best field first.

    A term belongs to the first field in `order` that has it; each field gives
    its quota, and room left over goes to what is left, field by field.
    """
    place = F.array_position(F.lit(order), F.col("field"))
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col("field"))
    each = fields.select("ws", "field", place.alias("place"), F.posexplode("tokens").alias("pos", "term"))
    first = each.withColumn("r", F.row_number().over(Window.partitionBy("ws", "term").orderBy("place", "pos"))).filter("r = 1")
    inside = first.withColumn("k", F.row_number().over(Window.partitionBy("ws", "field").orderBy("pos"))).withColumn("extra", (F.col("k") > quota).cast("int"))
    ranked = inside.withColumn("n", F.row_number().over(Window.partitionBy("ws").orderBy("extra", "place", "pos")))
    return ranked.filter(F.col("n") <= cap).select("ws", "term", "field")
