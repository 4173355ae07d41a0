"""Rows for people and other tools: search documents, scene logs, edit logs, stubs, link rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import alias_list
from ..functions.times import fmt_ts_compact
from .transcript import windows


def search_docs(segments: DataFrame, claims: DataFrame, screen: DataFrame) -> DataFrame:
    """(family, doc, ws, source, s, e, text, members): segments and their windows, claims, on-screen text."""
    none = F.array().cast("array<struct<s:double,e:double,text:string>>")
    key = lambda *c: F.concat_ws("-", *[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in c])
    row = lambda df, family, source, doc, members=none: df.select(F.lit(family).alias("family"), doc.alias("doc"), "ws", F.lit(source).alias("source"), "s", "e", "text", members.alias("members"))
    w = Window.partitionBy("ws").orderBy("pos")
    three = segments.select("ws", "pos", *[F.lead(F.struct("s", "e", "text"), k).over(w).alias(f"m{k}") for k in (0, 1, 2)])
    wide = windows(segments).join(three, ["ws", "pos"])
    members = F.slice(F.array("m0", "m1", "m2"), F.lit(1), F.size("members"))
    pos = F.col("pos")
    out = row(segments, "transcript", "transcript", key("t", F.col("ws"), pos)).unionByName(row(wide, "transcript", "window", key("w", F.col("ws"), pos), members))
    out = out.unionByName(row(claims, "understanding", "checkpoint", key("c", F.col("ws"), F.col("cp_id"))))
    return out.unionByName(row(screen, "screen", "ocr", key("o", F.col("ws"), F.col("s"))))


def select_claims(claims: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(chosen, unknown): claims of the ids in the order given, repeated ids once; all by start where no id is given."""
    if not ids:
        order = F.row_number().over(Window.partitionBy("ws").orderBy("s", "cp_id"))
        return claims.withColumn("place", order.cast("long")), claims.limit(0).select("cp_id")
    spark = claims.sparkSession
    wanted = spark.createDataFrame([(x, k) for k, x in enumerate(dict.fromkeys(ids), 1)], "cp_id string, place long")
    return claims.join(F.broadcast(wanted), "cp_id"), wanted.join(claims.select("cp_id").distinct(), "cp_id", "left_anti").select("cp_id")


def hotword_drift(videos: DataFrame, current: str | None) -> DataFrame:
    """(ws, drift): whether the glossary that a transcript was made with differs from the current one.

    videos: (ws, source, stamped, hotwords, rejected, prior: strings). A
    transcript is made with '<glossary> <prior>', so a prior at the end is
    taken off; hotwords that were rejected count where none were applied.
    Sources other than 'whisper' have none: null; an unstamped transcript:
    'legacy' if there is a glossary now, else null.
    """
    used = F.coalesce(F.nullif("hotwords", F.lit("")), F.nullif("rejected", F.lit("")))
    ends = F.coalesce((F.col("prior") != "") & F.endswith(used, F.col("prior")), F.lit(False))
    glossary = F.nullif(F.when(ends, F.trim(F.left(used, F.length(used) - F.length("prior")))).otherwise(used), F.lit(""))
    state = F.when(glossary.eqNullSafe(F.lit(current or None).cast("string")), "same").otherwise("changed")
    old = F.lit("legacy" if current else None).cast("string")
    return videos.select("ws", F.when(F.col("source") == "whisper", F.when(F.coalesce("stamped", F.lit(False)), state).otherwise(old)).alias("drift"))


def rewrite_links(links: DataFrame, moves: DataFrame) -> DataFrame:
    """(src, target, new): links (src, target) to their pages' current paths (old, new); fragments stay, others are unchanged."""
    page, fragment = F.substring_index("target", "#", 1), F.regexp_extract("target", "(#.*)$", 1)
    moved = links.withColumn("old", page).join(moves, "old", "left")
    return moved.select("src", "target", F.coalesce(F.concat("new", fragment), "target").alias("new"))


def top_per_video(rows: DataFrame, by: list[Column], top: int) -> DataFrame:
    """The first `top` rows of each ws in the order given."""
    place = F.row_number().over(Window.partitionBy("ws").orderBy(*by))
    return rows.withColumn("place", place.cast("long")).filter(F.col("place") <= top)


def distinct_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(ws, columns): distinct values of each, exact."""
    return rows.groupBy("ws").agg(*[F.count_distinct(c).alias(c) for c in columns])


#: Bits of a sketch's registers: a standard error of about 0.8 %.
SKETCH_BITS = 14


def distinct_sketches(rows: DataFrame, columns: list[str], bits: int = SKETCH_BITS) -> DataFrame:
    """(ws, columns): a sketch of each column's distinct values per video, to be kept as a table; new rows give sketches of their own, which unite with it."""
    return rows.groupBy("ws").agg(*[F.hll_sketch_agg(F.col(c).cast("string"), bits).alias(c) for c in columns])


def united_counts(sketches: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, columns): distinct values by estimate, from sketches of any parts of the rows; a value in several parts counts once. Without any value: 0."""
    return sketches.groupBy(*keys).agg(*[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in columns])


def blank_frames(candidates: DataFrame, least: float = 16.0) -> DataFrame:
    """Candidates (low, high: luma) that are not blank."""
    return candidates.filter(F.col("high") - F.col("low") >= least)


def scene_log(claims: DataFrame, levels: DataFrame, evidence_rows: DataFrame) -> DataFrame:
    """(ws, cp_id, s, e, arc, status, level, text, speakers, confidence, evidence): claims with their level and number of evidence rows (ws, cp_id).

    text is the hypothesis, which says more than the situation's tag, and the
    situation where there is none; speakers are joined, '-' without any.
    """
    n = evidence_rows.groupBy("ws", "cp_id").agg(F.count("*").alias("evidence"))
    text = F.coalesce(F.nullif(F.trim("hypothesis"), F.lit("")), "situation")
    who = F.array_join(F.filter("speakers", lambda x: F.trim(x) != ""), ", ")
    rows = claims.select("ws", "cp_id", "s", "e", F.nullif("arc", F.lit("")).alias("arc"), "status", text.alias("text"), F.coalesce(F.nullif(who, F.lit("")), F.lit("-")).alias("speakers"), "confidence")
    return rows.join(levels.select("ws", "cp_id", "level"), ["ws", "cp_id"], "left").join(n, ["ws", "cp_id"], "left").fillna(0, ["evidence"])


def edits_log(sequences: DataFrame, pin_states: DataFrame) -> DataFrame:
    """(ws, seq_id, intent, status, brief, cuts, length, rejected, drifted) of sequences (ws, seq_id, intent, status, brief: map, cuts: array<struct<s, e>>, alternatives: array<struct<s, e, reason>>).

    brief: 'key: value' in order of the keys; rejected: 'start-end reason' of
    each alternative, in order; drifted: claims whose pins are not current
    (`edits.pin_states`), joined.
    """
    drift = pin_states.filter("state = 'drifted'").groupBy("ws", "seq_id").agg(F.array_join(F.array_sort(F.collect_set("cp_id")), ", ").alias("drifted"))
    line = lambda text: F.regexp_replace(text, r"\s*\n\s*", " ")
    brief = F.array_join(F.transform(F.array_sort(F.map_entries("brief")), lambda x: F.concat(x["key"], F.lit(": "), line(x["value"]))), " · ")
    span = lambda a: F.when(a["s"].isNull() | a["e"].isNull(), "-").otherwise(F.concat(fmt_ts_compact(a["s"]), F.lit("-"), fmt_ts_compact(a["e"])))
    rejected = F.transform("alternatives", lambda a: F.concat(span(a), F.lit(" "), F.coalesce(line(a["reason"]), F.lit(""))))
    length = F.aggregate("cuts", F.lit(0.0), lambda acc, c: acc + c["e"] - c["s"])
    rows = sequences.select("ws", "seq_id", "intent", "status", F.coalesce(brief, F.lit("")).alias("brief"), F.size("cuts").cast("long").alias("cuts"), length.alias("length"), F.coalesce(F.array_join(rejected, "; "), F.lit("")).alias("rejected"))
    return rows.join(drift, ["ws", "seq_id"], "left").fillna("", ["drifted"])


def routing_stubs(summaries: DataFrame, index_name: str = "index") -> DataFrame:
    """(ws, name, aliases, head, line, reason): a stub for each timeline that leads to it and holds no content, from (ws: its path, title, labels, head, mode, advice, claims, duration).

    name: the parts of the path joined by '-', with '-ws' where that is the
    index's own; reason 'collision' where two paths give one name (none of
    them may be published), else null. aliases is a JSON list of the title and
    labels, trimmed, each once. Publishing is `storage.reconcile`.
    """
    joined = F.array_join(F.split("ws", "/"), "-")
    named = summaries.withColumn("name", F.when(joined == index_name, F.concat(joined, F.lit("-ws"))).otherwise(joined))
    alone = F.count("*").over(Window.partitionBy("name"))
    head = F.coalesce(F.nullif(F.trim("head"), F.lit("")), F.lit("—"))
    line = F.concat_ws(" · ", "mode", fmt_ts_compact(F.coalesce("duration", F.lit(0.0))), F.concat(F.lit("readiness "), "advice"), F.concat(F.lit("claims "), F.col("claims").cast("string")))
    return named.select("ws", "name", F.to_json(alias_list(F.col("title"), F.col("labels"))).alias("aliases"), head.alias("head"), line.alias("line"), F.when(alone > 1, "collision").alias("reason"))


def name_collisions(names: DataFrame) -> DataFrame:
    """(name, n): leaf names that several timelines (ws) share."""
    leaf = F.lower(F.regexp_extract("ws", r"([^/]*)$", 1))
    return names.groupBy(leaf.alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


def normalize_images(events: DataFrame) -> DataFrame:
    """events (ws, path, ...) with path normalised and reason: why an event is rejected (null: valid).

    Paths are relative, below frames/, without '..', with an image suffix.
    """
    path = F.regexp_replace(F.trim("path"), r"^\./", "")
    reason = (
        F.when(F.col("path").isNull() | (path == ""), "path").when(path.startswith("/") | path.rlike("^[A-Za-z]+:"), "absolute").when(path.rlike(r"(^|/)\.\.(/|$)"), "outside")
        .when(~path.startswith("frames/"), "folder").when(~path.rlike(r"(?i)\.(jpg|jpeg|png|webp)$"), "suffix")
    )
    return events.withColumn("path", path).withColumn("reason", reason)
