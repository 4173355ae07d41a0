"""Edit decisions: grounding of cuts, pins, cut boundaries and joins, event lists, timeline strips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import frame_clock, nominal_rate, srt_ts
from . import scans
from .spans import band_join, merge_spans, overlap_join, overlaps, subtract

SEQ = ["ws", "seq_id"]
CUT = [*SEQ, "ord"]


def cut_edges(cuts: DataFrame) -> DataFrame:
    """(ws, t): distinct ends of all cuts, rounded to 3 digits."""
    return cuts.select("ws", F.explode(F.array(F.round("s", 3), F.round("e", 3))).alias("t")).distinct()


def word_alignment(edges: DataFrame, words: DataFrame, width: float = 8.0, piece: float = scans.SECONDS) -> DataFrame:
    """edges (ws, t) with in_word, prev_end, next_start, gap, tail_gap from words (ws, s, e, word).

    in_word: the first word (by s, e, word) with s < t < e. prev_end: the greatest end up to t,
    next_start: the least start from t, both found in sorted passes over words
    and edges, in pieces of `piece` seconds. gap and tail_gap (6 digits) are null inside a word.
    """
    row = lambda df, t, kind: df.select("ws", t.alias("t"), F.lit(kind).alias("kind"))
    marks = row(words, F.col("e"), 0).union(row(edges, F.col("t"), 1)).union(row(words, F.col("s"), 2))
    order, where = ["t", "kind"], scans.cut(F.col("t"), piece)
    ends, starts = {"prev_end": F.when(F.col("kind") == 0, F.col("t"))}, {"next_start": F.when(F.col("kind") == 2, F.col("t"))}
    around = scans.filled(marks, ends, starts, order, where, ["ws"]).filter("kind = 1").drop("kind")
    inside = overlap_join(edges.select("ws", F.col("t").alias("s"), (F.col("t") + 1e-9).alias("e"), "t"), words.select("ws", F.col("s").alias("rs"), F.col("e").alias("re"), "word"), width).filter("rs < t AND t < re")
    held = inside.groupBy("ws", "t").agg(F.min_by("word", F.struct("rs", "re", "word")).alias("in_word"))
    out = around.join(held, ["ws", "t"], "left")
    free = F.col("in_word").isNull()
    return out.withColumn("gap", F.when(free, F.round(F.col("next_start") - F.col("prev_end"), 6))).withColumn("tail_gap", F.when(free, F.round(F.col("t") - F.col("prev_end"), 6)))


def mean_db(points: DataFrame, loud: DataFrame, before: bool, window: float = 0.4, name: str = "db") -> DataFrame:
    """points (ws, t) with the energy mean in dB, 2 digits, of loudness (ws, t, db) in the window before or after t; floor -99, null without values."""
    near = band_join(points.select("ws", "t").distinct(), loud.filter("db IS NOT NULL").select("ws", F.col("t").alias("rt"), "db"), window)
    side = F.col("rt") < F.col("t") if before else F.col("rt") >= F.col("t")
    level = F.round(F.greatest(F.lit(-99.0), 10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("db") / 10)))), 2)
    return points.join(near.filter(side).groupBy("ws", "t").agg(level.alias(name)), ["ws", "t"], "left")


def boundary_flags(aligned: DataFrame, loud: DataFrame, window: float = 0.4, tail: float = 0.12, step: float = 12.0) -> DataFrame:
    """aligned edges with db_before, db_after, step_db and flags: word_interior, tight_tail, loud_step, sorted."""
    both = mean_db(mean_db(aligned, loud, True, window, "db_before"), loud, False, window, "db_after")
    stepped = both.withColumn("step_db", F.round(F.abs(F.col("db_before") - F.col("db_after")), 2))
    flags = F.array(
        F.when(F.col("in_word").isNotNull() & (F.trim("in_word") != ""), "word_interior"),
        F.when((F.col("tail_gap") < tail) & (F.col("gap") >= 2.5 * tail), "tight_tail"),
        F.when(F.col("step_db") > step, "loud_step"),
    )
    return stepped.withColumn("flags", F.array_sort(F.array_compact(flags)))


def cut_joins(cuts: DataFrame, loud: DataFrame, ssim: DataFrame, frame: float = 0.04, window: float = 0.4, step: float = 12.0, alike: float = 0.75) -> DataFrame:
    """(ws, seq_id, ord, from_t, to_t, step_db, ssim, flags) of cuts that follow each other.

    ssim: (ws, seq_id, ord, ssim) between the last frame of cut ord and the first of the next.
    """
    w = Window.partitionBy(*SEQ).orderBy("ord")
    pairs = cuts.withColumn("to_t", F.lead(F.round("s", 3)).over(w)).filter("to_t IS NOT NULL").select(*CUT, F.round("e", 3).alias("from_t"), "to_t")
    out = mean_db(pairs.withColumnRenamed("from_t", "t"), loud, True, window, "out_db").withColumnRenamed("t", "from_t")
    both = mean_db(out.withColumnRenamed("to_t", "t"), loud, False, window, "in_db").withColumnRenamed("t", "to_t")
    stepped = both.join(ssim, CUT, "left").withColumn("step_db", F.round(F.abs(F.col("out_db") - F.col("in_db")), 2))
    flags = F.array(F.when(F.col("step_db") > step, "loud_join"), F.when((F.col("ssim") > alike) & (F.col("to_t") - F.col("from_t") > frame), "jump_cut_risk"))
    return stepped.select(*CUT, "from_t", "to_t", "step_db", "ssim", F.array_sort(F.array_compact(flags)).alias("flags"))


def cut_coverage(cuts: DataFrame, refs: DataFrame, claims: DataFrame, slack: float = 2.0, share: float = 0.1) -> DataFrame:
    """(ws, seq_id, ord, s, e, reason): parts of a cut that its claims leave open, and claims that miss it.

    refs: (ws, seq_id, ord, cp_id); claims: (ws, cp_id, s, e). At either end of
    a cut min(slack, share of its length) may stay open.
    """
    held = refs.join(claims.select("ws", "cp_id", F.col("s").alias("cs"), F.col("e").alias("ce")), ["ws", "cp_id"], "left").join(cuts.select(*CUT, "s", "e"), CUT)
    apart = held.filter(F.col("cs").isNull() | ~overlaps(F.col("s"), F.col("e"), F.col("cs"), F.col("ce"))).select(*CUT, F.col("s"), F.col("e"), F.lit("claim_outside").alias("reason"))
    open_ = subtract(cuts.select(*CUT, "s", "e"), held.filter("cs IS NOT NULL").select(*CUT, F.col("cs").alias("s"), F.col("ce").alias("e")), CUT)
    bounds = cuts.select(*CUT, F.col("s").alias("lo"), F.col("e").alias("hi"))
    allowed = F.least(F.lit(slack), share * (F.col("hi") - F.col("lo")))
    at_edge = ((F.col("s") == F.col("lo")) | (F.col("e") == F.col("hi"))) & (F.col("e") - F.col("s") <= allowed)
    body = open_.join(bounds, CUT).filter(~at_edge).select(*CUT, "s", "e", F.lit("uncovered").alias("reason"))
    return body.unionByName(apart.distinct())


def revision_hash(*fields: str) -> Column:
    """sha256 of the fields' JSON in the order given (keep it sorted)."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def pin_states(refs: DataFrame, pins: DataFrame, current: DataFrame) -> DataFrame:
    """(ws, seq_id, cp_id, state) of each pin (ws, seq_id, cp_id, revision) or reference (ws, seq_id, cp_id) that is not current.

    missing: referenced but not pinned; extra: pinned but not referenced;
    drifted: the claim's hash (ws, cp_id, revision) differs or is gone.
    """
    want = refs.select(*SEQ, "cp_id").distinct().withColumn("wanted", F.lit(True))
    both = want.join(pins.withColumnRenamed("revision", "pinned"), [*SEQ, "cp_id"], "full_outer").join(current, ["ws", "cp_id"], "left")
    state = F.when(F.col("pinned").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(~F.col("pinned").eqNullSafe(F.col("revision")), "drifted")
    return both.select(*SEQ, "cp_id", state.alias("state")).filter("state IS NOT NULL")


def edl_events(cuts: DataFrame, num: int, den: int, most: int = 999) -> DataFrame:
    """(ws, seq_id, event, src_in, src_out, rec_in, rec_out): clocks of each cut in the source and in the assembly (running sum of seconds), in the nominal rate; sequences of over `most` events are in `edl_rejects`."""
    w = Window.partitionBy(*SEQ).orderBy("ord")
    length = F.col("e") - F.col("s")
    end = cuts.withColumn("event", F.row_number().over(w).cast("long")).withColumn("end", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = end.withColumn("start", start).withColumn("of", F.count("*").over(Window.partitionBy(*SEQ))).filter(F.col("of") <= most)
    rate = nominal_rate(num, den)
    clock = lambda t: frame_clock(F.col(t), *map(F.lit, rate))
    return placed.select(*SEQ, "event", clock("s").alias("src_in"), clock("e").alias("src_out"), clock("start").alias("rec_in"), clock("end").alias("rec_out"))


def edl_rejects(cuts: DataFrame, most: int = 999) -> DataFrame:
    """(ws, seq_id, events, reason): sequences that no event list can hold, as readers of the format refuse longer ones whole."""
    n = cuts.groupBy(*SEQ).agg(F.count("*").alias("events")).filter(F.col("events") > most)
    return n.withColumn("reason", F.format_string(f"%d events, at most {most} fit: split by claims or write markers", "events"))


def srt_cues(cuts: DataFrame, segments: DataFrame, width: float = 8.0) -> DataFrame:
    """(ws, seq_id, cue, start, end, text): segments (ws, s, e, text) that a cut shows, in times of the assembly."""
    w = Window.partitionBy(*SEQ).orderBy("ord")
    placed = cuts.withColumn("rec", F.coalesce(F.sum(F.col("e") - F.col("s")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select(*CUT, "s", "e", "rec")
    shown = overlap_join(placed, segments.select("ws", F.col("s").alias("rs"), F.col("e").alias("re"), "text"), width)
    start = F.col("rec") + F.greatest("s", "rs") - F.col("s")
    end = F.col("rec") + F.least("e", "re") - F.col("s")
    cue = F.row_number().over(Window.partitionBy(*SEQ).orderBy("start_s", "ord", "rs", "text"))
    return shown.withColumn("start_s", start).withColumn("end_s", end).select(*SEQ, cue.cast("long").alias("cue"), srt_ts(F.col("start_s")).alias("start"), srt_ts(F.col("end_s")).alias("end"), "text")


def timeline_strip(claims: DataFrame, videos: DataFrame) -> DataFrame:
    """(ws, s, e, cp_id): blocks that do not overlap, later spans without what is covered before them, and fillers (null cp_id)."""
    both = claims.select("ws", "cp_id", "s", "e").join(videos.select("ws", "duration"), "ws")
    rows = both.select("ws", "cp_id", F.greatest("s", F.lit(0.0)).alias("s"), F.least("e", "duration").alias("e"))
    order = Window.partitionBy("ws").orderBy("s", "cp_id").rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.coalesce(F.max("e").over(order), F.lit(0.0))
    blocks = rows.withColumn("s", F.greatest("s", cursor)).filter("e > s")
    bounds = videos.select("ws", F.lit(0.0).alias("lo"), F.col("duration").alias("hi"))
    fill = subtract(bounds.select("ws", F.col("lo").alias("s"), F.col("hi").alias("e")), rows.filter("e > s"), ["ws"], 0.0)
    return blocks.select("ws", "s", "e", "cp_id").unionByName(fill.withColumn("cp_id", F.lit(None).cast("string")))


def receipt(rows: DataFrame, keys: list[str], text: Column, order: str) -> DataFrame:
    """(keys, lines, receipt): sha256 of the rows' text in order, joined by line ends. A group is one artifact, such as one sequence."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"])
    return rows.groupBy(*keys).agg(F.count("*").alias("lines"), F.sha2(F.array_join(lines, "\n"), 256).alias("receipt"))


def covered_share(cuts: DataFrame) -> DataFrame:
    """(ws, seq_id, length, unique_length): seconds shown, and seconds of the source they come from."""
    total = cuts.groupBy(*SEQ).agg(F.sum(F.col("e") - F.col("s")).alias("length"))
    return total.join(merge_spans(cuts, SEQ).groupBy(*SEQ).agg(F.sum(F.col("e") - F.col("s")).alias("unique_length")), SEQ)
