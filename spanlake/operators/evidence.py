"""How well claims are supported: transcript and visual evidence, coverage, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import TERMINAL
from .spans import coverage_gaps, merge_spans, overlaps


def transcript_support(claims: DataFrame, refs: DataFrame, segments: DataFrame) -> DataFrame:
    """(ws, cp_id, transcript_support): every reference exists and overlaps the claim; no references: false.

    claims: (ws, cp_id, s, e); refs: (ws, cp_id, ref, id_kind, id_key); segments: (ws, id_kind, id_key, s, e).
    Ids are typed: a number and a string never match.
    """
    spans = segments.select("ws", "id_kind", "id_key", F.col("s").alias("ss"), F.col("e").alias("se"))
    hit = F.coalesce(overlaps(F.col("s"), F.col("e"), F.col("ss"), F.col("se")), F.lit(False))
    by_ref = claims.join(refs, ["ws", "cp_id"]).join(spans, ["ws", "id_kind", "id_key"], "left").groupBy("ws", "cp_id", "ref").agg(F.bool_or(hit).alias("ok"))
    found = by_ref.groupBy("ws", "cp_id").agg(F.bool_and("ok").alias("ok"))
    return claims.select("ws", "cp_id").join(found, ["ws", "cp_id"], "left").select("ws", "cp_id", F.coalesce("ok", F.lit(False)).alias("transcript_support"))


def visual_issues() -> Column:
    """array of reasons why an image (tracked, kind, decodable, timestamps, t, span_s, span_e) does not support [s, e), empty if it does.

    An image that cannot be decoded, or is not there, is that alone; all others
    that apply are told: untracked, filmstrip, and time_unavailable or outside_span.
    """
    inside = lambda t: (F.col("s") <= t) & (t < F.col("e"))
    timed = (
        F.when(F.size("timestamps") > 0, F.exists("timestamps", inside))
        .when(F.col("t").isNotNull(), inside(F.col("t")))
        .when(F.col("span_s").isNotNull() & F.col("span_e").isNotNull(), overlaps(F.col("s"), F.col("e"), F.col("span_s"), F.col("span_e")))
    )
    found = F.array(
        F.when(~F.coalesce("tracked", F.lit(False)), "untracked"), F.when(F.coalesce(F.col("kind") == "filmstrip", F.lit(False)), "filmstrip"),
        F.when(timed.isNull(), "time_unavailable").when(~timed, "outside_span"),
    )
    unseen = F.when(F.col("tracked").isNull() & F.coalesce("decodable", F.lit(False)), F.array(F.lit("untracked")))
    return unseen.when(~F.coalesce("decodable", F.lit(False)), F.array(F.lit("undecodable"))).otherwise(F.array_compact(found))


def visual_evidence(claims: DataFrame, refs: DataFrame, images: DataFrame) -> DataFrame:
    """(ws, cp_id, path, issue): a row for each fault of a visual reference (ws, cp_id, path), one with a null issue where the image supports the claim.

    images has a row for each file that is there; tracked is null where no event names it.
    """
    each = claims.select("ws", "cp_id", "s", "e").join(refs, ["ws", "cp_id"]).join(images, ["ws", "path"], "left")
    return each.select("ws", "cp_id", "path", F.explode_outer(visual_issues()).alias("issue"))


def modality(visual: Column, transcript: Column) -> Column:
    """The level of support by which kinds of evidence there are."""
    return F.when(visual & transcript, "cross_modal").when(visual, "visual_only").when(transcript, "transcript_only").otherwise("unsupported")


def declared_levels(claims: DataFrame, transcript_refs: DataFrame, visual_refs: DataFrame) -> DataFrame:
    """(ws, cp_id, declared): the level that a claim's references (ws, cp_id) claim, whether they hold or not."""
    has = lambda df, name: df.select("ws", "cp_id").distinct().withColumn(name, F.lit(True))
    both = claims.select("ws", "cp_id").join(has(transcript_refs, "t"), ["ws", "cp_id"], "left").join(has(visual_refs, "v"), ["ws", "cp_id"], "left").fillna(False, ["t", "v"])
    return both.select("ws", "cp_id", modality(F.col("v"), F.col("t")).alias("declared"))


def support_levels(claims: DataFrame, transcript: DataFrame, visual: DataFrame) -> DataFrame:
    """claims with transcript_support, visual_support and level."""
    seen = visual.groupBy("ws", "cp_id").agg(F.bool_or(F.col("issue").isNull()).alias("visual_support"))
    both = claims.join(transcript, ["ws", "cp_id"], "left").join(seen, ["ws", "cp_id"], "left").fillna(False, ["transcript_support", "visual_support"])
    return both.withColumn("level", modality(F.col("visual_support"), F.col("transcript_support")))


def covered(spans: DataFrame, videos: DataFrame, name: str) -> DataFrame:
    """(ws, name): length of the union of the spans inside each video with any."""
    islands = merge_spans(spans.select("ws", "s", "e").join(videos.select("ws", "duration"), "ws"), ["ws"], F.col("duration"))
    return islands.groupBy("ws").agg(F.sum(F.col("e") - F.col("s")).alias(name))


def coverage_status(claims: DataFrame, videos: DataFrame) -> DataFrame:
    """One row per video: claims by status, covered and verified ratio, mean confidence, number of gaps."""
    n = lambda status: F.count_if(F.col("status") == status).alias(status)
    counts = claims.groupBy("ws").agg(F.count("*").alias("claims"), n("hypothesized"), n("verified"), n("corrected"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    gaps = coverage_gaps(claims.select("ws", "s", "e"), videos).groupBy("ws").agg(F.count("*").alias("gaps"))
    out = videos.select("ws", "duration").join(counts, "ws", "left").join(covered(claims, videos, "cov"), "ws", "left")
    out = out.join(covered(claims.filter(F.col("status").isin(*TERMINAL)), videos, "ver"), "ws", "left").join(gaps, "ws", "left")
    ratio = lambda x: F.when(F.col("duration") > 0, F.round(F.coalesce(x, F.lit(0.0)) / F.col("duration"), 4)).otherwise(F.lit(0.0))
    # without any claim the whole video is one gap
    bare = F.when(F.col("claims").isNull() & (F.col("duration") > 3.0), 1).otherwise(0)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("claims", "hypothesized", "verified", "corrected")]
    return out.select("ws", *zero, ratio(F.col("cov")).alias("covered_ratio"), ratio(F.col("ver")).alias("verified_ratio"), "mean_confidence", F.coalesce("gaps", bare).cast("long").alias("gaps"))


def support(levels: DataFrame, videos: DataFrame) -> DataFrame:
    """(ws, settled, supported, supported_ratio) per video: settled claims, those of them with support, and the share of the video that these cover together."""
    settled = levels.filter(F.col("status").isin(*TERMINAL))
    held = settled.filter("level <> 'unsupported'")
    n = settled.groupBy("ws").agg(F.count("*").alias("settled"), F.count_if(F.col("level") != "unsupported").alias("supported"))
    out = videos.select("ws", "duration").join(n, "ws", "left").join(covered(held, videos, "sup"), "ws", "left").fillna(0, ["settled", "supported", "sup"])
    ratio = F.when(F.col("duration") > 0, F.round(F.col("sup") / F.col("duration"), 4)).otherwise(F.lit(0.0))
    return out.select("ws", "settled", "supported", ratio.alias("supported_ratio"))


def readiness(status: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """status with score and advice: cover_gaps, verify_more or converged.

    With `support` (ws, settled, supported, supported_ratio) the supported
    ratio stands for the verified one, and a settled claim without support
    asks for more; without it this is the older rule.
    """
    if support is not None:
        status = status.join(support, "ws", "left").fillna(0, ["settled", "supported", "supported_ratio"])
    c, m = F.col("covered_ratio"), F.least(F.coalesce("mean_confidence", F.lit(0.0)), F.lit(1.0))
    v = F.col("verified_ratio") if support is None else F.col("supported_ratio")
    short = v < 0.6 if support is None else (v < 0.6) | (F.col("supported") < F.col("settled"))
    advice = F.when((F.col("gaps") > 0) | (c < 0.999), "cover_gaps").when(short, "verify_more").otherwise("converged")
    return status.withColumn("score", F.round(0.4 * c + 0.4 * v + 0.2 * m, 3)).withColumn("advice", advice)


def verification_issues(levels: DataFrame, visual: DataFrame) -> DataFrame:
    """(ws, cp_id, code, artifact): settled claims without support, visual faults, corrections without a note.

    Where levels have a column legacy (the claim has evidence in free form),
    claims that have that alone are legacy_unstructured too.
    """
    settled = levels.filter(F.col("status").isin(*TERMINAL))
    missing = settled.filter("level = 'unsupported'").select("ws", "cp_id", F.lit("missing_support").alias("code"), F.lit(None).cast("string").alias("artifact"))
    faults = visual.filter("issue IS NOT NULL").join(settled.select("ws", "cp_id"), ["ws", "cp_id"]).select("ws", "cp_id", F.concat(F.lit("visual_"), "issue").alias("code"), F.col("path").alias("artifact"))
    notes = settled.filter("status = 'corrected' AND (note IS NULL OR trim(note) = '')").select("ws", "cp_id", F.lit("correction_note_missing").alias("code"), F.lit(None).cast("string").alias("artifact"))
    out = missing.unionByName(faults).unionByName(notes)
    if "legacy" not in levels.columns:
        return out
    return out.unionByName(settled.filter("legacy AND level = 'unsupported'").select("ws", "cp_id", F.lit("legacy_unstructured").alias("code"), F.lit(None).cast("string").alias("artifact")))


def corpus_totals(issues: DataFrame) -> DataFrame:
    """(ws, code, n): issue counts by video and code, with totals (null ws, null code) from one rollup."""
    return issues.rollup("ws", "code").agg(F.count("*").alias("n"))


def corpus_counts(ready: DataFrame, levels: DataFrame) -> DataFrame:
    """(kind, name, n): videos by advice (of `readiness`) and settled claims by level."""
    advice = ready.groupBy("advice").agg(F.count("*").alias("n")).select(F.lit("advice").alias("kind"), F.col("advice").alias("name"), "n")
    level = levels.filter(F.col("status").isin(*TERMINAL)).groupBy("level").agg(F.count("*").alias("n")).select(F.lit("level").alias("kind"), F.col("level").alias("name"), "n")
    return advice.unionByName(level)


def details(rows: DataFrame, keys: list[str], order: list[str], cap: int = 20) -> DataFrame:
    """The first `cap` rows of each group with place, and total, the number of all of its rows: a list to read, whose total is not cut."""
    group = Window.partitionBy(*keys)
    numbered = rows.withColumn("place", F.row_number().over(group.orderBy(*order)).cast("long"))
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    return numbered.filter(F.col("place") <= cap).join(totals, keys)


def corpus_rows(ready: DataFrame, issues: DataFrame) -> DataFrame:
    """(ws, advice, verified_ratio, supported_ratio, settled, supported, issues): a row per video of `readiness` by support; issues is 'code:n' in order of the codes."""
    n = issues.groupBy("ws", "code").agg(F.count("*").alias("n"))
    told = n.groupBy("ws").agg(F.array_join(F.array_sort(F.collect_list(F.concat("code", F.lit(":"), F.col("n").cast("string")))), ",").alias("issues"))
    return ready.select("ws", "advice", "verified_ratio", "supported_ratio", "settled", "supported").join(told, "ws", "left").fillna("", ["issues"])
