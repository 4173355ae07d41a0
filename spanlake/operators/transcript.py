"""Transcripts: windows, word and speaker assignment, splitting, quality gates, captions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import repetition_ratio
from .spans import bins, overlap_join


def valid_segments(raw: DataFrame) -> DataFrame:
    """Segments with text and finite 0 <= s < e."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return raw.filter(ok("s") & ok("e") & F.col("text").isNotNull() & (F.col("s") >= 0) & (F.col("s") < F.col("e")))


def uncertain() -> Column:
    """conf < 0.6 where there is one, else logprob < -1 or no_speech_prob > 0.5."""
    return F.when(F.col("conf").isNotNull(), F.col("conf") < 0.6).otherwise(F.coalesce((F.col("logprob") < -1.0) | (F.col("no_speech_prob") > 0.5), F.lit(False)))


def windows(segments: DataFrame, gap: float = 5.0) -> DataFrame:
    """(ws, pos, s, e, text, members): a segment with one or two that follow, while gaps are at most `gap`; two members at least."""
    w = Window.partitionBy("ws").orderBy("pos")
    nxt = [F.lead(F.struct("s", "e", "text", "pos"), k).over(w).alias(f"n{k}") for k in (1, 2)]
    rows = segments.select("ws", "pos", "s", "e", "text", *nxt).filter(F.col("n1.s") - F.col("e") <= gap)
    third = F.col("n2.s") - F.col("n1.e") <= gap
    text = F.concat_ws(" ", "text", "n1.text", F.when(third, F.col("n2.text")))
    members = F.when(third, F.array("pos", "n1.pos", "n2.pos")).otherwise(F.array("pos", "n1.pos"))
    return rows.select("ws", "pos", "s", F.when(third, F.col("n2.e")).otherwise(F.col("n1.e")).alias("e"), text.alias("text"), members.alias("members"))


def assign_speakers(segments: DataFrame, turns: DataFrame, width: float = 8.0) -> DataFrame:
    """segments (ws, pos, s, e) with the speaker of greatest overlap in time, the earlier turn on ties, null if none."""
    pairs = overlap_join(segments.select("ws", "pos", "s", "e"), turns.select("ws", F.col("pos").alias("turn"), F.col("s").alias("rs"), F.col("e").alias("re"), "speaker"), width)
    shared = F.least("e", "re") - F.greatest("s", "rs")
    by_speaker = pairs.withColumn("shared", shared).groupBy("ws", "pos").agg(F.min_by("speaker", F.struct(-F.col("shared"), F.col("turn"))).alias("speaker"))
    return segments.drop("speaker").join(by_speaker, ["ws", "pos"], "left")


def assign_words(segments: DataFrame, words: DataFrame, slack: float = 0.01, width: float = 8.0) -> DataFrame:
    """(ws, pos, k, word_s, word_e, word, p): words (ws, k, s, e, word, p) that start in [s - slack, e + slack) of a segment."""
    a = segments.select("ws", "pos", (F.col("s") - slack).alias("lo"), (F.col("e") + slack).alias("hi")).withColumn("bin", F.explode(bins(F.col("lo"), F.col("hi"), width)))
    b = words.select("ws", "k", F.col("s").alias("word_s"), F.col("e").alias("word_e"), "word", "p").withColumn("bin", F.floor(F.col("word_s") / width).cast("long"))
    return a.join(b, ["ws", "bin"]).filter("word_s >= lo AND word_s < hi").drop("bin", "lo", "hi")


def split_on_gaps(assigned: DataFrame, gap: float = 1.5, between: str = " ") -> DataFrame:
    """(ws, pos, part, s, e, text, conf): a segment's words (of `assign_words`) cut where more than `gap` passes between two; words without p count as 0."""
    w = Window.partitionBy("ws", "pos").orderBy("word_s", "k")
    new = F.coalesce((F.col("word_s") - F.lag("word_e").over(w) > gap).cast("int"), F.lit(0))
    cut = assigned.withColumn("new", new).withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_s", "k", "word"))), lambda x: x["word"]), between)
    return cut.groupBy("ws", "pos", "part").agg(F.min("word_s").alias("s"), F.max_by("word_e", F.struct("word_s", "k")).alias("e"), text.alias("text"), F.round(F.avg(F.coalesce("p", F.lit(0.0))), 3).alias("conf"))


def split_segments(segments: DataFrame, words: DataFrame, gap: float = 1.5, between: str = "") -> DataFrame:
    """(ws, id, s, e, text, conf): segments (ws, pos, s, e, text, conf) with those cut whose words pause for more than `gap`, ids anew.

    A segment without a pause, or with fewer than two words, stays as it is.
    Words carry their own blanks where `between` is empty.
    """
    parts = split_on_gaps(assign_words(segments, words), gap, between)
    part = F.struct("part", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"), F.trim("text").alias("text"), "conf")
    cut = parts.groupBy("ws", "pos").agg(F.collect_list(part).alias("parts")).filter(F.size("parts") > 1)
    own = F.array(F.struct(F.lit(0).cast(parts.schema["part"].dataType).alias("part"), "s", "e", "text", F.col("conf").cast("double").alias("conf")))
    each = segments.join(cut, ["ws", "pos"], "left").select("ws", "pos", F.explode(F.coalesce("parts", own)).alias("x")).select("ws", "pos", "x.*")
    return each.withColumn("id", F.row_number().over(Window.partitionBy("ws").orderBy("pos", "part")).cast("long") - 1).select("ws", "id", "s", "e", "text", "conf")


def segments_from_words(words: DataFrame) -> DataFrame:
    """(ws, id, s, e, text, conf): words (ws, pos, k, s, e, word, p) put together by segment; ids renumber what has text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ")
    made = words.groupBy("ws", "pos").agg(F.min("s").alias("s"), F.max_by("e", "k").alias("e"), F.trim(text).alias("text"), F.round(F.avg("p"), 3).alias("conf")).filter("text <> ''")
    return made.withColumn("id", F.row_number().over(Window.partitionBy("ws").orderBy("pos")).cast("long") - 1).select("ws", "id", "s", "e", "text", "conf")


def transcript_coverage(segments: DataFrame, speech: DataFrame) -> DataFrame:
    """(ws, spoken, speech, coverage, collapsed): seconds transcribed against seconds of speech found (ws, s, e); collapsed below 0.5 of 60 s or more."""
    a = segments.groupBy("ws").agg(F.sum(F.col("e") - F.col("s")).alias("spoken"))
    b = speech.groupBy("ws").agg(F.sum(F.col("e") - F.col("s")).alias("speech"))
    both = b.join(a, "ws", "left").withColumn("spoken", F.coalesce("spoken", F.lit(0.0)))
    ratio = F.when(F.col("speech") > 0, F.round(F.col("spoken") / F.col("speech"), 3))
    return both.select("ws", "spoken", "speech", ratio.alias("coverage"), ((F.col("speech") >= 60) & (F.col("spoken") / F.col("speech") < 0.5)).alias("collapsed"))


def hotword_contamination(segments: DataFrame, hotwords: list[str]) -> DataFrame:
    """(ws, segments, hit_share, unique_share, contaminated): 5 segments or more, half with a hotword, at most 30 % unique texts."""
    hit = F.exists(F.lit(hotwords), lambda h: F.contains(F.col("text"), h)) if hotwords else F.lit(False)
    n = segments.groupBy("ws").agg(F.count("*").alias("segments"), F.avg(hit.cast("double")).alias("hit_share"), (F.count_distinct(F.trim("text")) / F.count("*")).alias("unique_share"))
    return n.withColumn("contaminated", (F.col("segments") >= 5) & (F.col("hit_share") >= 0.5) & (F.col("unique_share") <= 0.3))


def quality_flags(segments: DataFrame, words: DataFrame) -> DataFrame:
    """(ws, pos, repetitive, compressed, unlikely, unsure): why a segment with text would be rejected.

    Top token share of 0.6 or more (12 tokens at least), compression_ratio
    above 2.4, mean logprob below -1, mean p of its words (ws, pos, p) below
    0.1. What is null does not count against a segment.
    """
    sure = words.groupBy("ws", "pos").agg(F.avg("p").alias("mean_p"))
    no = lambda c: F.coalesce(c, F.lit(False))
    flags = [
        (repetition_ratio(F.col("text")) >= 0.6).alias("repetitive"),
        no(F.col("compression_ratio") > 2.4).alias("compressed"),
        no(F.col("logprob") < -1.0).alias("unlikely"),
        no(F.col("mean_p") < 0.1).alias("unsure"),
    ]
    return segments.filter(F.trim("text") != "").join(sure, ["ws", "pos"], "left").select("ws", "pos", *flags)


def transcript_qc(segments: DataFrame, words: DataFrame, speech: DataFrame, hotwords: list[str]) -> DataFrame:
    """(ws, segments, rejected, collapsed, contaminated, advice): what to do about a transcript.

    `tail` where it stops early but the part before its end is healthy (only
    what follows is to be made again), `full` where it collapsed, is
    contaminated by hotwords or half of its segments or more are rejected,
    else `keep`.
    """
    flags = quality_flags(segments, words)
    bad = flags.groupBy("ws").agg(F.count_if(F.col("repetitive") | F.col("compressed") | F.col("unlikely") | F.col("unsure")).alias("rejected"))
    held = hotword_contamination(segments, hotwords).select("ws", "segments", "contaminated")
    early = transcript_coverage(segments, speech).select("ws", "collapsed").join(prefix_speech(speech, segments).select("ws", "healthy"), "ws", "left")
    out = held.join(bad, "ws", "left").join(early, "ws", "left").fillna(0, ["rejected"]).fillna(False, ["collapsed", "healthy"])
    worn = F.col("contaminated") | (F.col("rejected") * 2 >= F.col("segments"))
    advice = F.when(worn, "full").when(F.col("collapsed"), F.when(F.col("healthy"), "tail").otherwise("full")).otherwise("keep")
    return out.select("ws", "segments", "rejected", "collapsed", "contaminated", advice.alias("advice"))


def best_transcript(attempts: DataFrame) -> DataFrame:
    """(ws, attempt, spoken): the attempt (ws, attempt, s, e) with most seconds, the first one on ties."""
    spoken = attempts.groupBy("ws", "attempt").agg(F.sum(F.col("e") - F.col("s")).alias("spoken"))
    return spoken.groupBy("ws").agg(F.min_by(F.struct("attempt", "spoken"), F.struct(-F.col("spoken"), F.col("attempt"))).alias("x")).select("ws", "x.attempt", "x.spoken")


def splice_tail(segments: DataFrame, tail: DataFrame, stalls: DataFrame) -> DataFrame:
    """(ws, id, s, e, text): segments up to the stall time (ws, stall) with the repaired tail after it, renumbered; without tail rows the old ones stay."""
    mended = tail.select("ws").distinct()
    head = segments.join(stalls, "ws", "left").join(mended.withColumn("mended", F.lit(True)), "ws", "left").filter("mended IS NULL OR stall IS NULL OR s < stall")
    shifted = tail.join(stalls, "ws").select("ws", (F.col("s") + F.col("stall")).alias("s"), (F.col("e") + F.col("stall")).alias("e"), "text", F.lit(1).alias("late"), "pos")
    both = head.select("ws", "s", "e", "text", F.lit(0).alias("late"), "pos").unionByName(shifted)
    return both.withColumn("id", F.row_number().over(Window.partitionBy("ws").orderBy("late", "pos")).cast("long") - 1).select("ws", "id", "s", "e", "text")


def dedupe_rolling(cues: DataFrame, longest: float = 12.0) -> DataFrame:
    """Cues (ws, s, e, text) of rolling captions merged: a cue that begins with the end of the merged one before goes into it.

    Overlap is the longest run of words that ends the merged text and begins
    the cue; they merge while the span stays within `longest` seconds. Beyond
    that a cue wholly contained still extends the end, any other stands alone.
    A fold in order over partitions that hold videos whole, in order of time;
    what is in work is one merged cue, however long a video is.
    """
    kind = cues.schema["ws"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None  # ws, s, e, words
        for batch in batches:
            done = []
            for ws, s, e, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words = text.split()
                if last and last[0] == ws:
                    held = last[3]
                    n = next((k for k in range(min(len(words), len(held)), 0, -1) if held[-k:] == words[:k]), 0)
                    if n == len(words):
                        last[2] = max(last[2], e)
                        continue
                    if n and e - last[1] <= longest:
                        last[2] = max(last[2], e)
                        held += words[n:]
                        continue
                if last:
                    done.append(last)
                last = [ws, s, e, words]
            if done:
                yield merged(done, batch.schema)
        if last:
            yield merged([last], batch.schema)

    def merged(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
        ws, s, e, words = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ws, s, e, [" ".join(w) for w in words]), schema, strict=True)], schema.names)

    rows = cues.select("ws", F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"), "text")
    return rows.repartition("ws").sortWithinPartitions("ws", "s", "e", "text").mapInArrow(fold, f"ws {kind}, s double, e double, text string")


def prefix_speech(speech: DataFrame, segments: DataFrame) -> DataFrame:
    """(ws, stall, heard, spoken, healthy): speech before the last segment ends, and whether half of it is transcribed."""
    last = segments.groupBy("ws").agg(F.max("e").alias("stall"), F.sum(F.col("e") - F.col("s")).alias("spoken"))
    heard = speech.join(last, "ws").groupBy("ws", "stall", "spoken").agg(F.sum(F.greatest(F.lit(0.0), F.least("e", "stall") - F.col("s"))).alias("heard"))
    return heard.withColumn("healthy", F.when(F.col("heard") > 0, F.col("spoken") / F.col("heard") >= 0.5).otherwise(False))
