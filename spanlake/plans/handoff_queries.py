"""Queries of what is handed to editing tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import handoff
from .base import Book
from .edit_queries import SRT
from .summary_queries import TOLD, told
from .timeline_queries import REPLAY, claims

book = Book()

#: Each cut cites its own claim and the one after it; pins hold an even line number, so odd ones have drifted, and cp-007 is not pinned.
GROUNDS = f"""{REPLAY}, rk AS (SELECT ws, seq_id, ord, 0 AS k, cp_id FROM v_cuts UNION ALL SELECT ws, seq_id, ord, 1, concat('cp-', lpad(cast((event_id + 1) % 20 AS varchar), 3, '0')) FROM v_cuts),
ct AS (SELECT rk.*, CASE WHEN rk.cp_id <> 'cp-007' THEN 'r' || cast(line_no - line_no % 2 AS varchar) END AS pin, l.cp_id IS NOT NULL AS known, coalesce(line_no % 2 = 1 AND rk.cp_id <> 'cp-007', false) AS drifted, status FROM rk LEFT JOIN latest l ON l.ws = rk.ws AND l.cp_id = rk.cp_id)"""


def selected(v):
    cuts, c = v("v_cuts"), claims(v)
    after = F.concat(F.lit("cp-"), F.lpad(((F.col("event_id") + 1) % 20).cast("string"), 3, "0"))
    refs = cuts.select("ws", "seq_id", "ord", F.lit(0).alias("k"), "cp_id").union(cuts.select("ws", "seq_id", "ord", F.lit(1), after))
    revision = lambda n: F.concat(F.lit("r"), n.cast("string"))
    now = c.select("ws", "cp_id", revision(F.col("line_no")).alias("revision"), "status", "confidence")
    pin = F.when(F.col("cp_id") != "cp-007", revision(F.col("line_no") - F.col("line_no") % 2))
    pins = refs.select("ws", "seq_id", "cp_id").distinct().join(c.select("ws", "cp_id", "line_no"), ["ws", "cp_id"]).select("ws", "seq_id", "cp_id", pin.alias("revision"))
    made = cuts.withColumns({"note": F.when(F.col("ord") % 3 == 0, "a note").otherwise(""), "role": F.when(F.col("ord") % 3 == 1, "opening"), "intent": F.lit("an intent")})
    return handoff.selection(made, refs, pins, now)


@book.add(f"""WITH {GROUNDS}, h AS (SELECT ws, seq_id, ord, string_agg(cp_id, ',' ORDER BY k) AS cp_ids, coalesce(string_agg(concat(cp_id, '@', pin), ',' ORDER BY k) FILTER (pin IS NOT NULL), '') AS pins,
  coalesce(string_agg(concat(cp_id, ':', status, ':', cast(drifted AS varchar)), ',' ORDER BY k) FILTER (known), '') AS states FROM ct GROUP BY ALL)
SELECT ws, seq_id, ord, concat(seq_id, '-', lpad(cast(ord AS varchar), 2, '0')) AS row_id, s, e, CASE ord % 3 WHEN 0 THEN 'a note' WHEN 1 THEN 'opening' ELSE 'an intent' END AS note, cp_ids, pins, states FROM v_cuts JOIN h USING (ws, seq_id, ord)""")
def cut_selection(v):
    told_of = lambda of, say: F.array_join(F.transform(F.filter("cp_ids", lambda c: F.map_contains_key(F.col(of), c)), say), ",")
    state = lambda c: F.concat(c, F.lit(":"), F.col("states")[c]["status"], F.lit(":"), F.col("states")[c]["drifted"].cast("string"))
    pins = told_of("pins", lambda c: F.concat(c, F.lit("@"), F.col("pins")[c]))
    return selected(v).withColumns({"pins": pins, "states": told_of("states", state), "cp_ids": F.array_join("cp_ids", ",")})


@book.add(f"""WITH {GROUNDS}, o AS (SELECT ws, seq_id, cp_id, min(ROW(ord, k)) AS r, max(pin) AS pin, bool_or(known AND drifted) AS drifted FROM ct GROUP BY ALL)
SELECT ws, seq_id, string_agg(cp_id, ',' ORDER BY r) AS cp_ids, coalesce(string_agg(concat(cp_id, '@', pin), ',' ORDER BY r) FILTER (pin IS NOT NULL), '') AS pins, coalesce(string_agg(cp_id, ',' ORDER BY r) FILTER (drifted), '') AS drifted FROM o GROUP BY ws, seq_id""")
def handoff_receipts(v):
    return handoff.receipts(selected(v)).withColumns({c: F.array_join(c, ",") for c in ("cp_ids", "pins", "drifted")})


@book.add(f"WITH {TOLD} SELECT ws, cp_id, concat(cp_id, ' [', status, ']') AS name, coalesce(situation, hypothesis) AS comment, cast(s * 12 AS bigint) AS frame_in, cast(e * 12 AS bigint) AS frame_out FROM td")
def claim_markers(v):
    """At 25/2 frames a second, which markers count as 12."""
    return handoff.markers(told(v), 25, 2)


RATIONAL = "concat(cast(cast(round_even(({0}) * 30000 / 1001, 0) AS bigint) * 1001 AS varchar), '/30000s')"


@book.add(f"""WITH z AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY ws, seq_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z, concat(seq_id, '-', lpad(cast(ord AS varchar), 2, '0')) AS name FROM v_cuts)
SELECT ws, seq_id, ord, name, {RATIONAL.format("z")} AS "offset", {RATIONAL.format("s")} AS start, {RATIONAL.format("e - s")} AS duration, concat(name, ' [cut]') AS marker, CASE ord % 3 WHEN 0 THEN 'a note' WHEN 1 THEN 'opening' ELSE 'an intent' END AS note FROM z""")
def clip_rows(v):
    return handoff.clips(selected(v).withColumn("status", F.lit("cut")), 30000, 1001)


@book.add(f"""WITH {REPLAY} SELECT c.ws, c.seq_id, c.ord, concat(c.seq_id, '-', lpad(cast(c.ord AS varchar), 2, '0')) AS name, cast(round_even(c.s * 24, 0) AS bigint) AS start_frame, cast(round_even((c.e - c.s) * 24, 0) AS bigint) AS frames, CASE WHEN l.status IN ('verified', 'corrected') THEN 'GREEN' ELSE 'YELLOW' END AS color
FROM v_cuts c LEFT JOIN latest l ON l.ws = c.ws AND l.cp_id = c.cp_id""")
def timeline_items(v):
    """Cuts in the state of the claim they cite first."""
    own = F.col("states")[F.col("cp_ids")[0]]["status"]
    return handoff.timeline_items(selected(v).withColumn("status", own), 24, 1)


@book.add(f"""WITH x AS (SELECT ws, s, e, text FROM v_seg WHERE trim(text) <> '' UNION ALL SELECT ws, t, t + 1, label FROM v_hits WHERE ws NOT IN (SELECT ws FROM v_seg WHERE trim(text) <> ''))
SELECT ws, row_number() OVER (PARTITION BY ws ORDER BY s, e, text) AS cue, {SRT.format("cast(round(s * 1000) AS bigint)")} AS start, {SRT.format("cast(round(e * 1000) AS bigint)")} AS "end", trim(text) AS text FROM x""")
def subtitle_cues(v):
    """Hits stand for what is read on screen."""
    return handoff.subtitle_cues(v("v_seg"), v("v_hits").select("ws", F.col("t").alias("s"), (F.col("t") + 1).alias("e"), F.col("label").alias("text")))
