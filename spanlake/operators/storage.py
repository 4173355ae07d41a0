"""File inventories, purge plans, fingerprints, publishing plans, metric gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import file_category


def storage_report(files: DataFrame) -> DataFrame:
    """(ws, media, captures, clips, text, total): bytes by category, from files (ws, path, size); null ws: all."""
    kinds = ["media", "captures", "clips", "text"]
    sums = [F.coalesce(F.sum(F.when(F.col("category") == k, F.col("size"))), F.lit(0)).cast("long").alias(k) for k in kinds]
    return files.withColumn("category", file_category(F.col("path"))).rollup("ws").agg(*sums, F.sum("size").cast("long").alias("total"))


def stale(files: DataFrame, now: Column, days: int) -> DataFrame:
    """(ws, age_days, size): timelines whose newest file (ws, size, mtime: date) is older than `days`."""
    each = files.groupBy("ws").agg(F.max("mtime").alias("newest"), F.sum("size").cast("long").alias("size"))
    return each.select("ws", F.datediff(now, "newest").cast("long").alias("age_days"), "size").filter(F.col("age_days") > days)


def purge_plan(files: DataFrame, categories: list[str]) -> DataFrame:
    """(ws, category, files, size): what a purge of the categories would free; nothing is deleted."""
    return files.withColumn("category", file_category(F.col("path"))).filter(F.col("category").isin(categories)).groupBy("ws", "category").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("size"))


def fingerprint(files: DataFrame) -> DataFrame:
    """(ws, mark): a fingerprint of all files (ws, path, size, mtime) that does not depend on their order.

    Hashes are summed, so that no timeline's file list is gathered.
    """
    h = F.xxhash64("path", "size", "mtime").cast("decimal(38,0)")
    return files.groupBy("ws").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(h).cast("string")), 256).alias("mark"))


def changed(now: DataFrame, cache: DataFrame) -> DataFrame:
    """(ws, state): new, changed or gone against a cache of (ws, mark)."""
    both = now.withColumnRenamed("mark", "now").join(cache.withColumnRenamed("mark", "then"), "ws", "full_outer")
    state = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("then"), "changed")
    return both.select("ws", state.alias("state")).filter("state IS NOT NULL")


def reconcile(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, action): publish, keep, remove or refuse, from expected (name, content) and existing (name, content, owned)."""
    want = expected.withColumnRenamed("content", "want").withColumn("wanted", F.lit(True))
    both = want.join(existing.withColumnRenamed("content", "have"), "name", "full_outer")
    action = (
        F.when(F.col("wanted").isNull() & F.col("owned"), "remove").when(F.col("wanted").isNull(), "keep")
        .when(F.col("owned").isNull(), "publish").when(~F.col("owned"), "refuse")
        .when(F.col("want").eqNullSafe(F.col("have")), "keep").otherwise("publish")
    )
    return both.select("name", action.alias("action"))


def golden_bands(metrics: DataFrame) -> DataFrame:
    """(name, metric, lo, hi): 20 % and 2 around each value (name, metric, value)."""
    return metrics.select("name", "metric", F.greatest(F.lit(0), F.floor(F.col("value") * 0.8) - 2).cast("long").alias("lo"), (F.floor(F.col("value") * 1.2) + 2).cast("long").alias("hi"))


def range_gate(metrics: DataFrame, bands: DataFrame) -> DataFrame:
    """(name, metric, value, ok): within its band; without a band it fails."""
    both = metrics.join(bands, ["name", "metric"], "left")
    return both.select("name", "metric", "value", F.coalesce(F.col("value").between(F.col("lo"), F.col("hi")), F.lit(False)).alias("ok"))


def gate(metrics: DataFrame, bands: DataFrame, labels: DataFrame, wanted: DataFrame, walls: DataFrame, ceilings: DataFrame) -> DataFrame:
    """(name, check, ok): every check of a run: metrics within their bands (`range_gate`), labels (name, key, value) equal to the wanted ones, walls (name, wall) up to their ceilings (name, ceiling). What has nothing to be held against fails."""
    yes = lambda c: F.coalesce(c, F.lit(False)).alias("ok")
    ranges = range_gate(metrics, bands).select("name", F.col("metric").alias("check"), "ok")
    same = labels.join(wanted.withColumnRenamed("value", "want"), ["name", "key"], "left").select("name", F.col("key").alias("check"), yes(F.col("value") == F.col("want")))
    fast = walls.join(ceilings, "name", "left").select("name", F.lit("wall").alias("check"), yes(F.col("wall") <= F.col("ceiling")))
    return ranges.unionByName(same).unionByName(fast)
