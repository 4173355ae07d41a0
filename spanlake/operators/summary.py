"""Rows about whole videos: content mode, briefs, tags, quotes, queues, points to verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tag_format
from .ledger import TERMINAL
from .transcript import uncertain


def content_mode() -> Column:
    """Mode from (speech_ratio, segments, ocr_spans, scenes, highlights, duration); null counts were never computed."""
    per_minute = F.when(F.col("duration") > 0, F.col("ocr_spans") / (F.col("duration") / 60)).otherwise(F.lit(0.0))
    ocr = F.coalesce(F.col("ocr_spans") > 0, F.lit(False))
    low = F.col("speech_ratio") < 0.35
    caption = low & F.coalesce((per_minute >= 5) & (F.col("ocr_spans") >= 5), F.lit(False))
    loop = F.coalesce((F.col("scenes") <= 1) & (F.col("highlights") == 0), F.lit(False))
    return (
        F.when(caption, "caption-led").when((F.col("segments") == 0) & loop, "loop").when((F.col("segments") == 0) & ocr, "silent with text").when(F.col("segments") == 0, "silent")
        .when(~low & ocr, "text-on-screen").when(low, "visual-led").otherwise("speech-led")
    )


def video_facts(videos: DataFrame, segments: DataFrame, scenes: DataFrame | None, bursts: DataFrame | None, screen: DataFrame | None) -> DataFrame:
    """(ws, duration, segments, uncertain, speech_ratio, scenes, highlights, ocr_spans); a signal that is None, or a video that it lacks, stays null or 0."""
    s = segments.groupBy("ws").agg(F.count("*").alias("segments"), F.count_if(uncertain()).alias("uncertain"), F.sum(F.col("e") - F.col("s")).alias("spoken"))
    out = videos.select("ws", "duration").join(s, "ws", "left").fillna(0, ["segments", "uncertain", "spoken"])
    for name, rows in (("scenes", scenes), ("highlights", bursts), ("ocr_spans", screen)):
        if rows is None:
            out = out.withColumn(name, F.lit(None).cast("long"))
        else:
            out = out.join(rows.groupBy("ws").agg(F.count("*").alias(name)), "ws", "left").fillna(0, [name])
    return out.withColumn("speech_ratio", F.when(F.col("duration") > 0, F.round(F.least(F.col("spoken") / F.col("duration"), F.lit(1.0)), 4)).otherwise(F.lit(0.0))).drop("spoken")


def heads(rows: DataFrame, name: str, item: Column, order: list, most: int) -> DataFrame:
    """(ws, name, name_total): the first `most` items of each video's rows in order, and how many there are."""
    place = F.row_number().over(Window.partitionBy("ws").orderBy(*order))
    placed = rows.select("ws", place.alias("place"), item.alias("item"))
    first = F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "item"))))
    return placed.groupBy("ws").agg(F.transform(first, lambda x: x["item"]).alias(name), F.count("*").alias(f"{name}_total"))


def brief(facts: DataFrame, readiness: DataFrame, *parts: DataFrame) -> DataFrame:
    """One summary row per video: facts, mode, readiness, and the columns of `parts` (ws, ...), such as `heads` of bursts, scenes, events, gaps, chapters, intent hits, or the hotwords' drift; null where a part lacks the video."""
    out = facts.withColumn("mode", content_mode()).join(readiness.drop("duration"), "ws", "left")
    for part in parts:
        out = out.join(part, "ws", "left")
    return out


def video_summary(facts: DataFrame, ready: DataFrame, levels: DataFrame, narratives: DataFrame, length: int = 80) -> DataFrame:
    """(ws, mode, advice, claims, head, labels, tags, speech_ratio, scenes, highlights) per video.

    facts as `video_facts`; ready: (ws, advice, claims); levels: claims (ws,
    first_line, status, level, situation, hypothesis, speakers, entities, tags);
    narratives: (ws, text). head: the first line of the narrative that is not
    blank or in parentheses, else what the first settled and supported claim
    says, else 'to be verified' with claims and '—' without. labels and tags of
    such claims, sorted, each once: lists of one video.
    """
    promoted = levels.filter(F.col("status").isin(*TERMINAL) & (F.col("level") != "unsupported"))
    trimmed = lambda x: F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda y: F.trim(y)), lambda y: y != "")
    said = promoted.groupBy("ws").agg(F.min_by(F.coalesce(F.nullif("situation", F.lit("")), "hypothesis"), "first_line").alias("said"))
    names = promoted.select("ws", F.explode(trimmed(F.concat(F.coalesce("speakers", F.array().cast("array<string>")), F.coalesce("entities", F.array().cast("array<string>"))))).alias("x"))
    labels = names.groupBy("ws").agg(F.array_sort(F.collect_set("x")).alias("labels"))
    tags = promoted.select("ws", F.explode(trimmed(F.col("tags"))).alias("x")).groupBy("ws").agg(F.array_sort(F.collect_set(tag_format(F.col("x")))).alias("tags"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("(")))
    told = narratives.select("ws", F.get(lines, F.lit(0)).alias("line")).groupBy("ws").agg(F.min("line").alias("line"))
    out = facts.withColumn("mode", content_mode()).join(ready.select("ws", "advice", "claims"), "ws", "left").fillna(0, ["claims"])
    for part in (said, labels, tags, told):
        out = out.join(part, "ws", "left")
    head = F.coalesce("line", "said", F.when(F.col("claims") > 0, "to be verified"), F.lit("—"))
    none = F.array().cast("array<string>")
    return out.select("ws", "mode", "advice", "claims", F.substring(head, 1, length).alias("head"), F.coalesce("labels", none).alias("labels"), F.coalesce("tags", none).alias("tags"), "speech_ratio", "scenes", "highlights")


def tag_index(tags: DataFrame, modes: DataFrame) -> DataFrame:
    """(mode, tag, hits) of tags (ws, tag) and modes (ws, mode)."""
    return tags.join(modes.select("ws", "mode"), "ws").groupBy("mode", "tag").agg(F.count("*").alias("hits"))


def quote_log(quotes: DataFrame) -> DataFrame:
    """(ws, speaker, n, first, last) of quotes (ws, t, speaker, text) that have a text."""
    said = quotes.filter("text IS NOT NULL AND trim(text) <> ''")
    return said.groupBy("ws", "speaker").agg(F.count("*").alias("n"), F.min_by("text", F.struct("t", "text")).alias("first"), F.max_by("text", F.struct("t", "text")).alias("last"))


def quote_rows(claims: DataFrame) -> DataFrame:
    """(ws, place, cp_id, t, speaker, text): quotes of claims (quotes: array<struct<t, speaker, text>>) that have a text, numbered in each ws by time; one without a time comes first."""
    each = claims.select("ws", "cp_id", F.posexplode("quotes").alias("k", "q")).select("ws", "cp_id", "k", "q.t", "q.speaker", "q.text").filter("trim(text) <> ''")
    place = F.row_number().over(Window.partitionBy("ws").orderBy(F.coalesce("t", F.lit(0.0)), "cp_id", "k"))
    return each.select("ws", place.cast("long").alias("place"), "cp_id", "t", "speaker", "text")


def relation_rows(triples: DataFrame) -> DataFrame:
    """(label, ws, cp_id, subj, pred, obj): each relation (ws, cp_id, subj, pred, obj) under both its ends, once if they are one."""
    return triples.select(F.explode(F.array_distinct(F.array("subj", "obj"))).alias("label"), "ws", "cp_id", "subj", "pred", "obj").filter("label IS NOT NULL")


def relation_log(triples: DataFrame) -> DataFrame:
    """(label, side, n): relations (subj, pred, obj) seen from either entity."""
    return triples.select("pred", F.explode(F.array(F.struct(F.col("subj").cast("string").alias("label"), F.lit("subject").alias("side")), F.struct(F.col("obj").cast("string").alias("label"), F.lit("object").alias("side")))).alias("x")).groupBy("x.label", "x.side").agg(F.count("*").alias("n"))


def improvement_queue(durable: DataFrame, noted: DataFrame, ready: DataFrame | None = None, narrated: DataFrame | None = None, least: int = 3) -> DataFrame:
    """(label, task) of durable (label, rows, durable, related): add a note where none is (label), add a relation to frequent ones without.

    With ready (ws, advice) and narrated (ws) also: add a narrative to
    converged timelines without one; their label is the ws.
    """
    note = durable.filter("durable").join(noted.select("label"), "label", "left_anti").select("label", F.lit("note").alias("task"))
    relation = durable.filter((F.col("rows") >= least) & ~F.col("related")).select("label", F.lit("relation").alias("task"))
    out = note.unionByName(relation)
    if ready is None or narrated is None:
        return out
    bare = ready.filter("advice = 'converged'").join(narrated.select("ws").distinct(), "ws", "left_anti")
    return out.unionByName(bare.select(F.col("ws").cast("string").alias("label"), F.lit("narrative").alias("task")))


def layer_metrics(durable: DataFrame, triples: DataFrame, aliases: DataFrame, quotes: DataFrame | None = None, noted: DataFrame | None = None, index_bytes: DataFrame | None = None, limit: int = 10 * 1024) -> DataFrame:
    """One row: entities, durable, candidates, relations, alias_groups; where given quotes (rows), notes_filled (rows), and index_bytes (column size, summed) with over_limit."""
    groups = aliases.groupBy("leader").agg(F.count("*").alias("n")).filter("n > 1")
    n = lambda df: df.agg(F.count("*")).scalar()
    out = durable.agg(F.count("*").alias("entities"), F.count_if("durable").alias("durable"), F.count_if(~F.col("durable")).alias("candidates"))
    columns = {"relations": n(triples), "alias_groups": n(groups)}
    if quotes is not None:
        columns["quotes"] = n(quotes)
    if noted is not None:
        columns["notes_filled"] = n(noted)
    if index_bytes is not None:
        columns["index_bytes"] = index_bytes.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long")).scalar()
    out = out.select("*", *[c.alias(name) for name, c in columns.items()])
    return out if index_bytes is None else out.withColumn("over_limit", F.col("index_bytes") > limit)


def verification_points(claims: DataFrame, segments: DataFrame, bursts: DataFrame, scenes: DataFrame, silence: float = 20.0) -> DataFrame:
    """(ws, t, why): where to look next: weak claims and segments, long silence, a change of speaker, bursts, scene changes."""
    at = lambda df, t, why: df.select("ws", t.alias("t"), F.lit(why).alias("why"))
    w = Window.partitionBy("ws").orderBy("s", "pos")
    seg = segments.withColumns({"before": F.lag("e").over(w), "spoke": F.lag("speaker").over(w)})
    out = at(claims.filter("confidence < 0.7"), F.col("s"), "weak_claim").unionByName(at(seg.filter("conf < 0.6"), F.col("s"), "weak_segment"))
    out = out.unionByName(at(seg.filter(F.col("s") - F.col("before") >= silence), F.col("before"), "silence")).unionByName(at(seg.filter("spoke <> speaker"), F.col("s"), "speaker_change"))
    return out.unionByName(at(bursts, F.col("s"), "burst")).unionByName(at(scenes, F.col("t"), "scene_change"))


def shot_scale(boxes: str | Column) -> Column:
    """close-up, medium or long by the largest box (array of [x, y, w, h]) of a frame; null without boxes."""
    top = F.array_max(F.transform(boxes, lambda b: b[2] * b[3]))
    return F.when(top >= 0.05, "close-up").when(top >= 0.008, "medium").when(top.isNotNull(), "long")


def montage(scenes: DataFrame, videos: DataFrame, per_minute: float = 10.0) -> DataFrame:
    """(ws, scenes, montage): ten scene changes a minute or more."""
    n = scenes.groupBy("ws").agg(F.count("*").alias("scenes"))
    both = videos.select("ws", "duration").join(n, "ws", "left").fillna(0, ["scenes"])
    return both.select("ws", "scenes", F.coalesce((F.col("duration") > 0) & (F.col("scenes") / (F.col("duration") / 60) >= per_minute), F.lit(False)).alias("montage"))


def chapter_spans(videos: DataFrame) -> DataFrame:
    """(ws, start, end, title) of container chapters, drafts of spans."""
    return videos.filter(F.size("chapters") > 0).select("ws", F.inline("chapters"))


#: Videos whose windows make a partition.
VIDEOS = 2048


def strip_plan(videos: DataFrame, longest: float = 112.0, step: float = 7.0, most: int = 16) -> DataFrame:
    """(ws, strip, s, e, cells, mids): windows of at most `longest` seconds, each in cells at most `step` apart (`most` at most), with their mid-points. Bounds are rounded first, and mid-points lie between rounded bounds.

    Videos come in order of duration, VIDEOS to a partition: those of one length
    have equal windows, which take little room next to each other, and a file of
    so many does not outgrow Parquet's dictionary of times.
    """
    n = F.greatest(F.ceil(F.col("duration") / longest), F.lit(1))
    known = videos.filter("duration > 0").select("ws", "duration")
    ordered = known.repartitionByRange(known.count() // VIDEOS + 1, "duration", "ws").sortWithinPartitions("duration", "ws")
    each = ordered.select("ws", "duration", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("strip"))
    s, e = F.col("duration") * F.col("strip") / F.col("n"), F.col("duration") * (F.col("strip") + 1) / F.col("n")
    cells = F.greatest(F.least(F.ceil(F.col("duration") / F.col("n") / step), F.lit(most)), F.lit(1)).cast("int")
    rows = each.select("ws", "strip", F.round(s, 3).alias("s"), F.round(e, 3).alias("e"), cells.alias("cells"))
    mids = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda k: F.round(F.col("s") + (k + 0.5) * (F.col("e") - F.col("s")) / F.col("cells"), 3))
    return rows.select("ws", "strip", "s", "e", F.col("cells").cast("long").alias("cells"), mids.alias("mids"))


def tail_candidates(videos: DataFrame, points: int = 5, span: float = 2.5, margin: float = 0.2) -> DataFrame:
    """(ws, t): evenly spaced points in the last seconds before the margin, each once."""
    high = F.greatest(F.col("duration") - margin, F.lit(0.0))
    low = F.greatest(F.col("duration") - span, F.lit(0.0))
    each = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.round(low + (F.greatest(high, low) - low) * k / (points - 1), 3))
    return videos.select("ws", F.explode(F.array_distinct(each)).alias("t"))


def tail_stability(pairs: DataFrame) -> DataFrame:
    """(ws, t): the tail candidate most like a neighbour, the later on ties; pairs (ws, t, ssim) with ssim to the next candidate, null where it could not be measured. Without any measure there is no row."""
    w = Window.partitionBy("ws").orderBy("t")
    best = pairs.withColumn("best", F.greatest("ssim", F.lag("ssim").over(w))).filter("best IS NOT NULL")
    return best.groupBy("ws").agg(F.max_by("t", F.struct("best", "t")).alias("t"))


def keywords(tags: str | Column, labels: str | Column, first: int = 6, cap: int = 10) -> Column:
    """Sorted union of tags and the first labels, at most `cap`."""
    return F.slice(F.array_sort(F.array_union(tags, F.slice(labels, 1, first))), 1, cap)


def index_rows(rows: DataFrame, limit_bytes: int, share: float = 0.6) -> DataFrame:
    """Rows of a corpus index (kind, grp, name, line, folded): analysed videos, then those that wait, of rows (grp, name, line, pending).

    Where the lines of the analysed ones exceed the share of the limit together
    they fold to a line per group, with how many it has; those that wait are
    listed by name either way.
    """
    ready = rows.filter("NOT pending")
    total = ready.agg((F.coalesce(F.sum(F.octet_length("line")), F.lit(0)) > share * limit_bytes).alias("folded"))
    folded = total.scalar()
    each = ready.withColumn("folded", folded)
    shown = each.filter("NOT folded").select(F.lit("video").alias("kind"), "grp", "name", "line", "folded")
    groups = each.filter("folded").groupBy("grp", "folded").agg(F.count("*").alias("n")).select(F.lit("group").alias("kind"), "grp", F.col("grp").alias("name"), F.concat_ws(" ", F.col("grp"), F.col("n").cast("string")).alias("line"), "folded")
    waiting = rows.filter("pending").withColumn("folded", folded).select(F.lit("pending").alias("kind"), "grp", "name", F.lit(None).cast("string").alias("line"), "folded")
    return shown.unionByName(groups).unionByName(waiting)
