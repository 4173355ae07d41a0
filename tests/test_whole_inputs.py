"""Queries read the whole of what they are given."""

import __spark_entry__ as entry
from spanlake.plans.reader_queries import FILES, written
from spanlake.sources import readers


def test_cues_cover_every_word(spark, tmp_path):
    texts = [(k, " ".join(f"d{k}w{n}" for n in range(size))) for k, size in enumerate([1, 3, 6, 7, 33, 34, 100, 3001])]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in entry.queries()["dedupe_rolling_cues"](spark, str(tmp_path)).collect():
        found.setdefault(r["ws"], set()).update(r["text"].split())
    assert found == {k: set(text.split()) for k, text in texts}


def test_late_repeats_reach_the_rolling_fold(spark, tmp_path):
    text = " ".join([f"w{n}" for n in range(60)] + ["same"] * 30)
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    last = entry.queries()["dedupe_rolling_cues"](spark, str(tmp_path)).orderBy("s").collect()[-1]
    assert last["e"] == 31.0 and last["text"].endswith("same same same") and last["text"].split().count("same") < 30


def test_search_reads_the_signs_of_every_turn(spark, tiny, tmp_path):
    spark.createDataFrame([(1, k, "user", "hello") for k in range(6)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "sign user")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{tiny}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    found = entry.queries()["search_with_windows"](spark, str(tmp_path)).collect()
    assert sorted((r["source"], r["s"]) for r in found) == [("ocr", 6.0 * k) for k in range(6)]


def test_sessions_count_hits_of_late_files(spark, tmp_path):
    """Files come in any order of time; hits that are just the gap apart are two sessions."""
    for at in (20 * 86400, 0, 10 * 86400):
        rows = [(k, at + t, 1, "view") for k, t in enumerate((0, 3600, 3600 + 6 * 3600))]
        spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string").selectExpr("event_id", "timestamp_seconds(t) AS ts", "user_id", "event_type").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    found = entry.queries()["stream_audio_sessions"](spark, str(tmp_path)).selectExpr("unix_seconds(start) AS s", "unix_seconds(end) AS e", "n").collect()
    assert sorted(map(tuple, found)) == sorted(x for at in (0, 10 * 86400, 20 * 86400) for x in ((at, at + 7 * 3600, 2), (at + 7 * 3600, at + 13 * 3600, 1)))


def test_folders_of_small_files_are_dealt_out(spark):
    """Many tasks write them."""
    rows = spark.range(60).selectExpr("id AS ws", "id % 2 AS grp", "concat('text ', id) AS value")
    found = readers.whole(spark, written(rows, ["grp", "ws"]), FILES)
    assert {r["value"] for r in found.collect()} == {f"text {k}\n" for k in range(60)}
    assert found.select("file").distinct().count() > 8  # part-00012-...: a number a task


def test_folders_are_listed_by_few_tasks(spark):
    root = written(spark.range(60).selectExpr("id AS ws", "concat('text ', id) AS value"), ["ws"])
    spark.sparkContext.setJobGroup("listing", "listing")
    pages = readers.read_pages(spark, root, FILES)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    held = spark.sparkContext.statusTracker()
    tasks = [held.getStageInfo(s).numTasks for j in held.getJobIdsForGroup("listing") for s in held.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert pages.count() == 60
