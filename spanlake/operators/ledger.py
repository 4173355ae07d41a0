"""Replay of append-only claim ledgers (ws, line_no, cp_id, status, s, e, confidence, ...).

A ledger is partitioned by (ws, cp_id), so a busy video does not gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states of a claim, and those that settle it (fixed values).
STATUSES = ("hypothesized", "verified", "corrected")
TERMINAL = ("verified", "corrected")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clamp_drift(log: DataFrame) -> DataFrame:
    """Ends that overrun the duration by at most min(3, max(0.05, 0.5 %)) become the duration."""
    over, d = F.col("e") - F.col("duration"), F.col("duration")
    slack = F.least(F.lit(3.0), F.greatest(F.lit(0.05), d * 0.005))
    return log.withColumn("e", F.when((over > 0) & (over <= slack), d).otherwise(F.col("e")))


def reject_reason(log: DataFrame) -> Column:
    """The first rule that a line breaks, else null."""
    c = F.col("confidence")
    return (
        F.when(F.col("cp_id").isNull() | (F.trim("cp_id") == ""), "id")
        .when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status")
        .when(F.col("hypothesis").isNull() | (F.trim("hypothesis") == ""), "hypothesis")
        .when(~finite(F.col("s")) | ~finite(F.col("e")), "span")
        .when(~((F.col("s") >= 0) & (F.col("s") < F.col("e"))), "order")
        .when(F.col("e") > F.col("duration"), "duration")
        .when(c.isNotNull() & ~(finite(c) & c.between(0, 1)), "confidence")
    )


def validated(log: DataFrame, replay: bool = True) -> DataFrame:
    """log with reason: why a line is rejected, null where it is valid; on replay small overruns are clamped first."""
    lines = clamp_drift(log) if replay else log
    return lines.withColumn("reason", reject_reason(lines))


def by_id() -> Window:
    return Window.partitionBy("ws", "cp_id").orderBy("line_no")


def accepted(log: DataFrame) -> DataFrame:
    """Valid lines but for those that would take a settled claim back to hypothesized."""
    valid = validated(log).filter("reason IS NULL").drop("reason")
    settled = F.max(F.col("status").isin(*TERMINAL)).over(by_id().rowsBetween(Window.unboundedPreceding, -1))
    return valid.withColumn("settled", settled).filter((F.col("status") != "hypothesized") | ~F.coalesce("settled", F.lit(False))).drop("settled")


def history(log: DataFrame) -> DataFrame:
    """Accepted lines with their revision number of the claim, from 1."""
    return accepted(log).withColumn("revision", F.row_number().over(by_id()).cast("long"))


def inherit(lines: DataFrame, present: str, value: str) -> DataFrame:
    """lines whose `value` is that of the last line of the claim that has the field at all (`present`), itself included."""
    held = F.last(F.when(F.col(present), F.struct(F.col(value).alias("v"))), ignorenulls=True).over(by_id())
    return lines.withColumn(value, held["v"])


def latest(log: DataFrame) -> DataFrame:
    """The last accepted line of each claim, with first_line: where the claim first appeared (ties of start sort by it)."""
    w = Window.partitionBy("ws", "cp_id")
    ranked = accepted(log).withColumn("last", F.row_number().over(w.orderBy(F.desc("line_no")))).withColumn("first_line", F.min("line_no").over(w))
    return ranked.filter("last = 1").drop("last")
