"""Replay and validation of edit-decision ledgers (ws, line_no, seq_id, intent, status, cuts: array of structs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import edits, ledger

#: States of a sequence in their order (fixed values).
RANKS = {"assembled": 0, "proposed": 1, "approved": 2}


def rank(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), status)


#: Characters that end a line, and those that XML has no place for (fixed values).
LINE_ENDS, NOT_XML = r"[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
#: Seconds that a cut of the older form may overrun the video.
OVERRUN = 0.5


def good_texts(items: Column) -> Column:
    """Whether all items are texts with more than blanks; null and empty lists are good."""
    return F.coalesce(F.forall(items, lambda x: F.coalesce(F.trim(x) != "", F.lit(False))), F.lit(True))


def good_refs(items: Column) -> Column:
    """As good_texts, on one line each and in characters that XML has."""
    return good_texts(items) & F.coalesce(F.forall(items, lambda x: F.coalesce(~x.rlike(LINE_ENDS) & ~x.rlike(NOT_XML), F.lit(False))), F.lit(True))


def reject_reason(overrun: float = 0.0) -> Column:
    """The first rule that a line (seq_id, intent, status, cuts: array<struct<s, e, ord, cp_ids, signals>>, duration) breaks, else null."""
    order = F.transform("cuts", lambda c, i: F.coalesce(c["ord"], (i + 1).cast("long")))
    inside = F.forall("cuts", lambda c: F.coalesce((c["s"] >= 0) & (c["s"] < c["e"]) & (c["e"] <= F.col("duration") + overrun), F.lit(False)))
    cited = F.forall("cuts", lambda c: (F.coalesce(F.size(c["cp_ids"]), F.lit(0)) > 0) | (F.coalesce(F.size(c["signals"]), F.lit(0)) > 0))
    clean = F.forall("cuts", lambda c: good_refs(c["cp_ids"]) & good_refs(c["signals"]))
    return (
        F.when(~F.coalesce(F.col("seq_id").rlike(r"^seq-\d{3,}$"), F.lit(False)), "id")
        .when(F.col("intent").isNull() | (F.trim("intent") == ""), "intent")
        .when(~F.coalesce(F.col("status").isin(*RANKS), F.lit(False)), "status")
        .when(F.coalesce(F.size("cuts"), F.lit(0)) < 1, "cuts")
        .when(~inside, "span")
        .when(F.size(F.array_distinct(order)) != F.size("cuts"), "order")
        .when(~clean, "reference")
        .when(~cited, "grounding")
    )


def shape_reason(alternatives: str = "alternatives", overrides: str = "overrides", pins: str = "pins") -> Column:
    """The first rule that what a line may have besides breaks, else null: alternatives: array<struct<s, e, reason>> inside the duration and with a reason, overrides: array of texts, pins: map of texts."""
    inside = F.forall(alternatives, lambda a: F.coalesce((a["s"] >= 0) & (a["s"] < a["e"]) & (a["e"] <= F.col("duration")), F.lit(False)))
    reasons = good_texts(F.transform(alternatives, lambda a: a["reason"]))
    return (
        F.when(~F.coalesce(inside, F.lit(True)), "alternative_span").when(~reasons, "alternative_reason").when(~good_texts(F.col(overrides)), "override")
        .when(~(good_texts(F.map_keys(pins)) & good_texts(F.map_values(pins))), "pin")
    )


def unknown_claims(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """(ws, line_no, seq_id, cp_id): cited claims that are not in the ledger (ws, cp_id)."""
    cited = lines.select("ws", "line_no", "seq_id", F.explode("cuts").alias("c")).select("ws", "line_no", "seq_id", F.explode("c.cp_ids").alias("cp_id")).distinct()
    return cited.join(claims.select("ws", "cp_id").distinct(), ["ws", "cp_id"], "left_anti").select("ws", "line_no", "seq_id", "cp_id")


def latest(lines: DataFrame) -> DataFrame:
    """The last accepted line of each sequence: a status never goes back. Closed form: what would go back is below the greatest rank before it."""
    w = Window.partitionBy("ws", "seq_id").orderBy("line_no")
    valid = lines.filter(reject_reason().isNull()).withColumn("rank", rank(F.col("status")))
    top = F.max("rank").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = valid.withColumn("top", top).filter("top IS NULL OR rank >= top")
    last = F.row_number().over(Window.partitionBy("ws", "seq_id").orderBy(F.desc("line_no")))
    return kept.withColumn("last", last).filter("last = 1").drop("last", "top", "rank")


def ungrounded(lines: DataFrame, claims: DataFrame) -> DataFrame:
    """(ws, line_no): lines past 'assembled' that the claims as they stand do not carry.

    claims: (ws, cp_id, status, supported, s, e). Each cut needs claims, all of
    them settled and supported, which overlap it and cover it together
    (`edits.cut_coverage`).
    """
    cuts = lines.filter("status <> 'assembled'").select("ws", F.col("line_no").alias("seq_id"), F.posexplode("cuts").alias("ord", "c")).select("ws", "seq_id", "ord", "c.s", "c.e", "c.cp_ids")
    refs = cuts.select(*edits.CUT, F.explode("cp_ids").alias("cp_id"))
    bare = cuts.filter(F.coalesce(F.size("cp_ids"), F.lit(0)) < 1)
    good = claims.filter(F.col("status").isin(*ledger.TERMINAL) & F.coalesce("supported", F.lit(False)))
    weak = refs.join(good.select("ws", "cp_id"), ["ws", "cp_id"], "left_anti")
    apart = edits.cut_coverage(cuts.drop("cp_ids"), refs, good)
    return bare.select("ws", "seq_id").unionByName(weak.select("ws", "seq_id")).unionByName(apart.select("ws", "seq_id")).distinct().withColumnRenamed("seq_id", "line_no")


def replay_rows(lines: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(ws, seq_id, line_no, status, rank, legacy, strict, lenient): what a replay asks of each line, by the rules of today and of the older form.

    With claims (as for `ungrounded`), lines must cite known claims, and those
    past 'assembled' without pins (a map; no column: none) must be carried by
    them; what is pinned was judged when it was written.
    """
    each = lines.select("*", rank(F.col("status")).alias("rank"), reject_reason().isNull().alias("strict"), reject_reason(OVERRUN).isNull().alias("lenient"))
    if claims is not None:
        pinned = F.col("pins").isNotNull() if "pins" in lines.columns else F.lit(False)
        bad = unknown_claims(lines, claims).select("ws", "line_no").unionByName(ungrounded(lines.filter(~pinned), claims)).distinct().withColumn("bad", F.lit(True))
        each = each.join(bad, ["ws", "line_no"], "left").withColumns({c: F.col(c) & F.col("bad").isNull() for c in ("strict", "lenient")})
    return each.select("ws", "seq_id", "line_no", "status", "rank", "legacy", "strict", "lenient").filter("lenient")


def latest_mixed(lines: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(ws, seq_id, line_no, status): as `latest` for ledgers with lines of the older form (legacy: boolean).

    Such a line may go back and overrun, unless one of today's form was
    accepted before it. Whether a line is accepted depends on those before it:
    a fold over each sequence's few lines. claims as for `replay_rows`.
    """
    rows = replay_rows(lines, claims).groupBy("ws", "seq_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "status", "rank", "legacy", "strict"))).alias("rows"))
    start = F.lit(None).cast("struct<line_no:bigint,status:string,rank:int,legacy:boolean,strict:boolean>")

    def step(held: Column, x: Column) -> Column:
        older = x["legacy"] & F.coalesce(held["legacy"], F.lit(True))
        return F.when(older | (x["strict"] & (x["rank"] >= F.coalesce(held["rank"], F.lit(-1)))), x).otherwise(held)

    found = rows.withColumn("held", F.aggregate("rows", start, step)).filter("held IS NOT NULL")
    return found.select("ws", "seq_id", "held.line_no", "held.status")
