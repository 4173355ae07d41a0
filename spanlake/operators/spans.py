"""Interval algebra on spans [s, e) of a timeline (columns ws, s, e)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Strict overlap: spans that only touch do not overlap."""
    return F.greatest(s1, s2) < F.least(e1, e2)


def merge_spans(spans: DataFrame, keys: list[str] = ["ws"], duration: Column | None = None) -> DataFrame:
    """Islands (keys, s, e): spans clamped to [0, duration], merged where the next start is at most the greatest end so far."""
    s = F.greatest(F.lit(0.0), F.col("s"))
    e = F.col("e") if duration is None else F.least(duration, F.col("e"))
    clamped = spans.select(*keys, s.alias("s"), e.alias("e")).filter("s < e")
    order = Window.partitionBy(*keys).orderBy("s", "e")
    top = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = clamped.withColumn("new", F.coalesce((F.col("s") > top).cast("int"), F.lit(1)))
    numbered = flagged.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def gaps(islands: DataFrame, bounds: DataFrame, keys: list[str] = ["ws"]) -> DataFrame:
    """Uncovered stretches (keys, s, e) of bounds (keys, lo, hi), head and tail included; islands lie inside the bounds.

    Both ends of the bounds stand in line with the islands, so that one window
    over the keys finds every gap.
    """
    ends = bounds.select(*keys, F.explode(F.array("lo", "hi")).alias("s")).withColumn("e", F.col("s"))
    marks = islands.select(*keys, "s", "e").unionByName(ends)
    before = F.lag("e").over(Window.partitionBy(*keys).orderBy("s", "e"))
    return marks.withColumn("before", before).filter("before < s").select(*keys, F.col("before").alias("s"), F.col("s").alias("e"))


def coverage_gaps(spans: DataFrame, videos: DataFrame, least: float = 3.0) -> DataFrame:
    """Gaps (ws, s, e) of each video (ws, duration) longer than `least`, rounded to 3 digits."""
    both = spans.select("ws", "s", "e").join(videos.select("ws", "duration"), "ws")
    islands = merge_spans(both, ["ws"], F.col("duration"))
    bounds = videos.select("ws", F.lit(0.0).alias("lo"), F.col("duration").alias("hi"))
    return gaps(islands, bounds).filter(F.col("e") - F.col("s") > least).select("ws", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"))


def subtract(outer: DataFrame, spans: DataFrame, keys: list[str], least: float = 1e-9) -> DataFrame:
    """What of each outer span (keys, s, e; keys are unique) no span (keys, s, e) covers, longer than `least`."""
    bounds = outer.select(*keys, F.col("s").alias("lo"), F.col("e").alias("hi"))
    inside = spans.select(*keys, "s", "e").join(bounds, keys).select(*keys, F.greatest("s", "lo").alias("s"), F.least("e", "hi").alias("e"))
    return gaps(merge_spans(inside, keys), bounds, keys).filter(F.col("e") - F.col("s") > least)


def bins(s: Column, e: Column, width: float) -> Column:
    """Numbers of the bins of `width` seconds that [s, e] meets."""
    return F.sequence(F.floor(s / width).cast("long"), F.floor(F.greatest(s, e) / width).cast("long"))


def overlap_join(left: DataFrame, right: DataFrame, width: float, keys: list[str] = ["ws"]) -> DataFrame:
    """Pairs of left (keys, s, e, ...) and right (keys, rs, re, ...) spans that overlap strictly.

    Both sides are dealt to bins of `width` seconds and joined on (keys, bin);
    a pair is kept in the bin of its first common second alone. No cross join.
    """
    a = left.withColumn("bin", F.explode(bins(F.col("s"), F.col("e"), width)))
    b = right.withColumn("bin", F.explode(bins(F.col("rs"), F.col("re"), width)))
    first = F.floor(F.greatest("s", "rs") / width).cast("long")
    return a.join(b, [*keys, "bin"]).filter(overlaps(F.col("s"), F.col("e"), F.col("rs"), F.col("re")) & (F.col("bin") == first)).drop("bin")


def band_join(left: DataFrame, right: DataFrame, width: float, keys: list[str] = ["ws"]) -> DataFrame:
    """Pairs of left (keys, t, ...) and right (keys, rt, ...) with abs(t - rt) <= width."""
    a = left.withColumn("bin", F.explode(F.sequence(F.floor(F.col("t") / width).cast("long") - 1, F.floor(F.col("t") / width).cast("long") + 1)))
    b = right.withColumn("bin", F.floor(F.col("rt") / width).cast("long"))
    return a.join(b, [*keys, "bin"]).filter(F.abs(F.col("t") - F.col("rt")) <= width).drop("bin")
