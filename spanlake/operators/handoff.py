"""Rows handed to editing tools: cut selections with pins and states, markers, clips, timelines, cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import frames, nominal_rate, rational_time, srt_ts
from .edits import CUT, SEQ
from .ledger import TERMINAL


def selection(cuts: DataFrame, refs: DataFrame, pins: DataFrame, current: DataFrame) -> DataFrame:
    """Cuts as rows to export, with what they are grounded on: cp_ids in the order cited, pins and states by claim.

    cuts: (ws, seq_id, ord, s, e, note, role, intent); refs: (ws, seq_id, ord, k, cp_id);
    pins: (ws, seq_id, cp_id, revision); current: (ws, cp_id, revision, status, confidence).
    pins is a map of the cited claims that are pinned; states a map of those
    in the ledger to (status, confidence, drifted): drifted if pinned to another
    revision. Lists and maps hold the claims of one cut.
    """
    now = current.select("ws", "cp_id", F.col("revision").alias("now"), "status", "confidence", F.lit(True).alias("known"))
    cited = refs.join(pins.select(*SEQ, "cp_id", F.col("revision").alias("pin")), [*SEQ, "cp_id"], "left").join(now, ["ws", "cp_id"], "left")
    drifted = F.coalesce(F.col("pin") != F.col("now"), F.lit(False))
    item = F.struct("k", "cp_id", "pin", "known", F.struct("status", "confidence", drifted.alias("drifted")).alias("state"))
    held = cited.groupBy(*CUT).agg(F.array_sort(F.collect_list(item)).alias("held"))
    first = F.array_distinct(F.transform("held", lambda x: x["cp_id"]))
    # a claim cited twice has the same pin and state in both places: the map takes one
    once = F.filter("held", lambda x, i: F.array_position(F.transform("held", lambda y: y["cp_id"]), x["cp_id"]) == i + 1)
    maps = held.select(
        *CUT, first.alias("cp_ids"),
        F.map_from_entries(F.transform(F.filter(once, lambda x: x["pin"].isNotNull()), lambda x: F.struct(x["cp_id"], x["pin"]))).alias("pins"),
        F.map_from_entries(F.transform(F.filter(once, lambda x: x["known"]), lambda x: F.struct(x["cp_id"], x["state"]))).alias("states"),
    )
    note = F.coalesce(F.nullif("note", F.lit("")), F.nullif("role", F.lit("")), F.col("intent"), F.lit(""))
    rows = cuts.join(maps, CUT, "left")
    return rows.select(*CUT, F.format_string("%s-%02d", "seq_id", F.col("ord").cast("long")).alias("row_id"), "s", "e", note.alias("note"), F.coalesce("cp_ids", F.array().cast("array<string>")).alias("cp_ids"), "pins", "states")


def markers(claims: DataFrame, num: int, den: int) -> DataFrame:
    """(ws, cp_id, name, comment, frame_in, frame_out) of claims (ws, cp_id, status, s, e, situation, hypothesis), in frames of the nominal rate."""
    rate = nominal_rate(num, den)
    at = lambda t: frames(F.col(t), *map(F.lit, rate))
    comment = F.trim(F.coalesce(F.nullif("situation", F.lit("")), "hypothesis"))
    return claims.select("ws", "cp_id", F.format_string("%s [%s]", "cp_id", "status").alias("name"), comment.alias("comment"), at("s").alias("frame_in"), at("e").alias("frame_out"))


def clips(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(ws, seq_id, ord, name, offset, start, duration, marker, note): rows (ws, seq_id, ord, row_id, s, e, status, note) laid end to end, as frame-aligned rational times."""
    length = F.col("e") - F.col("s")
    before = F.coalesce(F.sum(length).over(Window.partitionBy(*SEQ).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    at = lambda t: rational_time(t, F.lit(num), F.lit(den))
    return rows.select(*CUT, F.col("row_id").alias("name"), at(before).alias("offset"), at(F.col("s")).alias("start"), at(length).alias("duration"), F.format_string("%s [%s]", "row_id", "status").alias("marker"), "note")


def timeline_items(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(ws, seq_id, ord, name, start_frame, frames, color): source ranges of rows (ws, seq_id, ord, row_id, s, e, status) in frames; settled ones are GREEN, others YELLOW."""
    at = lambda t: frames(t, F.lit(num), F.lit(den))
    color = F.when(F.col("status").isin(*TERMINAL), "GREEN").otherwise("YELLOW")
    return rows.select(*CUT, F.col("row_id").alias("name"), at(F.col("s")).alias("start_frame"), at(F.col("e") - F.col("s")).alias("frames"), color.alias("color"))


def subtitle_cues(segments: DataFrame, screen: DataFrame) -> DataFrame:
    """(ws, cue, start, end, text): what is said (ws, s, e, text), or where a timeline has no words at all, what is read on screen (ws, s, e, text)."""
    said = segments.filter("trim(text) <> ''").select("ws", "s", "e", "text")
    read = screen.filter("trim(text) <> ''").select("ws", "s", "e", "text").join(said.select("ws").distinct(), "ws", "left_anti")
    cue = F.row_number().over(Window.partitionBy("ws").orderBy("s", "e", "text"))
    return said.unionByName(read).select("ws", cue.cast("long").alias("cue"), srt_ts(F.col("s")).alias("start"), srt_ts(F.col("e")).alias("end"), F.trim("text").alias("text"))


def receipts(rows: DataFrame) -> DataFrame:
    """(ws, seq_id, cp_ids, pins, drifted): of each sequence of `selection` the claims it stands on, each once by first cut, the pins as 'claim@revision', and the claims that drifted."""
    each = rows.select(*CUT, F.posexplode("cp_ids").alias("k", "cp_id"), F.col("pins").alias("p"), F.col("states").alias("t"))
    one = each.groupBy(*SEQ, "cp_id").agg(F.min(F.struct("ord", "k")).alias("at"), F.max(F.try_element_at("p", F.col("cp_id"))).alias("pin"), F.max(F.try_element_at("t", F.col("cp_id"))["drifted"]).alias("drifted"))
    held = F.array_sort(F.collect_list(F.struct("at", "cp_id", "pin", "drifted")))
    ids = lambda x: F.transform(x, lambda y: y["cp_id"])
    out = one.groupBy(*SEQ).agg(held.alias("h"))
    pinned = F.transform(F.filter("h", lambda y: y["pin"].isNotNull()), lambda y: F.concat(y["cp_id"], F.lit("@"), y["pin"]))
    return out.select(*SEQ, ids(F.col("h")).alias("cp_ids"), pinned.alias("pins"), ids(F.filter("h", lambda y: F.coalesce(y["drifted"], F.lit(False)))).alias("drifted"))
