"""Streaming jobs over the given tables, drained once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import jobs
from ..sources.tables import folder, saved
from .base import Book
from .summary_queries import MIXED, mixed_rows
from .timeline_queries import REPLAY

book = Book()


def stream(table: DataFrame) -> DataFrame:
    """A table of files as a stream: a copy of its rows in a few files, taken one file at a time."""
    spark = table.sparkSession
    path = f"{folder(spark)}/input-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)


def in_parts(table: DataFrame, order: str, n: int = 3) -> DataFrame:
    """The rows of table as a stream of n micro-batches, one folder of files each, in the order of a number column."""
    spark = table.sparkSession
    path = f"{folder(spark)}/input-{uuid.uuid4().hex}"
    top = table.agg(F.max(order)).first()[0] or 1
    part = F.greatest(F.ceil(F.col(order) * n / top), F.lit(1)).cast("int")
    # a part is so many files that each trigger takes: their names follow the order in which they are written
    files = spark.sparkContext.defaultParallelism
    for k in range(1, n + 1):
        table.filter(part == k).repartition(files).write.option("maxRecordsPerFile", 0).mode("append").parquet(f"{path}/part={k}")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).option("basePath", path).parquet(f"{path}/part=*")


def drained_in_time(table: DataFrame, job: Callable[[DataFrame], DataFrame], n: int = 3) -> DataFrame:
    """What a job in complete mode has of the rows of table (ts, ...), which come in n parts of time, each a run that goes on from the one before.

    No row is later than the watermark, as files in any order are where there are many.
    """
    spark, place = table.sparkSession, f"{folder(table.sparkSession)}/stream-{uuid.uuid4().hex}"
    first, last = table.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    at = F.unix_micros("ts") - F.lit(first)
    part = F.coalesce(F.greatest(F.ceil(at * n / ((last or 0) - (first or 0) or 1)), F.lit(1)), F.lit(1))
    for k in range(1, n + 1):
        table.filter(part == k).write.mode("append").parquet(f"{place}/input")
        found = jobs.drain(job(spark.readStream.schema(table.schema).parquet(f"{place}/input")), "", "complete", place)
    return found


@book.add("SELECT user_id AS ws, date_trunc('day', ts) AS start, count(*) AS n, sum(cast(floor(value) AS bigint)) AS total FROM events GROUP BY ALL", long="total")
def stream_loudness(v):
    e = v("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("ws"), F.floor("value").alias("value"))
    return jobs.drain(jobs.loudness(stream(e)), folder(e.sparkSession), "complete")


@book.add("""SELECT kind, start, count(*) AS n FROM (SELECT event_type AS kind, time_bucket(INTERVAL '12 hours', ts) AS start FROM events UNION ALL SELECT event_type, time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours' FROM events) GROUP BY ALL""")
def stream_scene_density(v):
    e = v("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    return jobs.drain(jobs.density(stream(e)), folder(e.sparkSession), "complete")


@book.add("""SELECT ws, start, count(*) AS n, round(count(*) / 720, 6) AS per_minute FROM (SELECT user_id AS ws, time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours' * k AS start FROM events, range(2) r(k)) GROUP BY ALL""")
def stream_burst_rate(v):
    """Windows of 12 hours every 6 hours: events come hours apart."""
    e = v("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("ws"))
    return jobs.drain(jobs.burst_rate(stream(e), "12 hours", "6 hours"), folder(e.sparkSession), "complete")


@book.add("""WITH o AS (SELECT user_id AS ws, event_type AS label, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS nw FROM events),
r AS (SELECT *, sum(nw) OVER (PARTITION BY ws, label ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT ws, label, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS "end", count(*) AS n FROM r GROUP BY ws, label, k""")
def stream_audio_sessions(v):
    e = v("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("ws"), F.col("event_type").alias("label"))
    return drained_in_time(e, jobs.sessions)


@book.add("SELECT DISTINCT ws, edge_id FROM v_image_events")
def stream_new_edges(v):
    e = v("v_image_events")
    return jobs.drain(jobs.new_edges(stream(e)).select("ws", "edge_id"), folder(e.sparkSession))


@book.add(f"WITH {REPLAY} SELECT ws, cp_id, line_no, status, s, e, confidence, first_line FROM latest")
def stream_ledger_latest(v):
    """Ledger lines in three micro-batches, folded into the latest of each claim in Spark's state."""
    log = v("v_cp_log")
    found = jobs.drain_updates(jobs.latest_claims(in_parts(log, "line_no")), ["ws", "cp_id"], folder(log.sparkSession))
    return found.select("ws", "cp_id", "line_no", "status", "s", "e", "confidence", "first_line")


@book.add("SELECT ws, edge_id, min(line_no) AS line_no FROM v_image_events GROUP BY ws, edge_id")
def stream_edge_table(v):
    e = v("v_image_events")
    return jobs.drain_updates(jobs.first_edges(in_parts(e, "line_no")), ["ws", "edge_id"], folder(e.sparkSession))


@book.add(f"WITH RECURSIVE {MIXED} SELECT ws, seq_id, line_no, status FROM mixed")
def stream_sequences(v):
    """Lines of sequence ledgers in three micro-batches; keyed state holds the line accepted last."""
    rows = saved(mixed_rows(v), "rows")
    return jobs.drain_updates(jobs.latest_sequences(in_parts(rows, "line_no")), ["ws", "seq_id"], folder(rows.sparkSession))


@book.add("SELECT ws, CASE WHEN ws % 3 = 0 THEN 2 ELSE 1 END AS times FROM (SELECT DISTINCT ws FROM v_files)", long="times")
def stream_changed(v):
    """Timelines come three times: new, every third with other sizes, and once more as they are."""
    files = v("v_files")
    visit = files.withColumn("visit", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("size", F.when((F.col("ws") % 3 == 0) & (F.col("visit") > 1), F.col("size") + 1).otherwise(F.col("size")))
    path = f"{folder(files.sparkSession)}/rebuilt-{uuid.uuid4().hex}"
    rebuild = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    jobs.drain_each(jobs.changed_timelines(in_parts(visit, "visit")), folder(files.sparkSession), rebuild)
    return files.sparkSession.read.schema("ws long, batch long").option("basePath", path).parquet(path).groupBy("ws").agg(F.count("*").alias("times"))
