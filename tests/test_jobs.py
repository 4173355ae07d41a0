"""Hand-computed cases, files, folds against brute force, and properties that oracles don't cover."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.functions import labels as lb
from spanlake.functions import text as tx
from spanlake.functions import times as tm
from spanlake.operators import edits, images, knowledge, ledger, search, sequences, signals, spans, summary, transcript
from spanlake.sources import readers
from spanlake.sources.adapters import view
from spanlake.sources.tables import folder, saved
from spanlake.streaming import jobs

LOG = "ws string, line_no long, cp_id string, status string, hypothesis string, s double, e double, duration double, confidence double"


def log(spark, rows):
    return spark.createDataFrame([("w", k, "cp", status, "h", s, e, 100.0, None) for k, (status, s, e) in enumerate(rows, 1)], LOG)


def test_a_settled_claim_stays(spark):
    assert ledger.latest(log(spark, [("verified", 1.0, 2.0), ("hypothesized", 3.0, 4.0)])).first()["line_no"] == 1


def test_drift_is_clamped_up_to_its_slack(spark):
    rows = ledger.validated(log(spark, [("verified", 1.0, 100.4), ("verified", 1.0, 100.6)])).orderBy("line_no").collect()
    assert [(r["e"], r["reason"]) for r in rows] == [(100.0, None), (100.6, "duration")]


def test_presence_differs_from_null(spark):
    rows = [("w", k, "cp", present, value) for k, (present, value) in enumerate([(True, "a"), (False, None), (True, None), (False, None)])]
    out = ledger.inherit(spark.createDataFrame(rows, "ws string, line_no long, cp_id string, present boolean, value string"), "present", "value")
    assert [r["value"] for r in out.orderBy("line_no").collect()] == ["a", "a", None, None]


def test_touching_spans_merge_and_short_tail_is_no_gap(spark):
    s = spark.createDataFrame([("w", 0.0, 5.0), ("w", 5.0, 9.0)], "ws string, s double, e double")
    assert [tuple(r) for r in spans.merge_spans(s).collect()] == [("w", 0.0, 9.0)]
    assert spans.coverage_gaps(s, spark.createDataFrame([("w", 12.0)], "ws string, duration double")).collect() == []
    assert not s.select(spans.overlaps(F.lit(0.0), F.lit(5.0), F.lit(5.0), F.lit(9.0)).alias("x")).first()["x"]


@pytest.mark.parametrize("partitions", [1, 7])
def test_spans_cover_as_a_sweep_does(spark, partitions):
    rng = random.Random(partitions)
    rows = [(w, float(a), float(a + rng.randint(0, 6))) for w in range(5) for a in (rng.randint(0, 60) for _ in range(12))]
    df = spark.createDataFrame(rows, "ws long, s double, e double").repartition(partitions)
    videos = spark.createDataFrame([(w, 60.0) for w in range(6)], "ws long, duration double")
    covered = {w: {x for ws, a, b in rows if ws == w for x in range(int(a), int(b)) if x < 60} for w in range(6)}
    merged = spans.merge_spans(df.join(videos, "ws"), ["ws"], F.col("duration")).groupBy("ws").agg(F.sum(F.col("e") - F.col("s")).alias("n"))
    assert {r["ws"]: r["n"] for r in merged.collect()} == {w: len(c) for w, c in covered.items() if c}
    gaps = spans.coverage_gaps(df, videos, 0.0).groupBy("ws").agg(F.sum(F.col("e") - F.col("s")).alias("n"))
    assert {r["ws"]: r["n"] for r in gaps.collect()} == {w: 60 - len(c) for w, c in covered.items() if len(c) < 60}


def test_blank_text_does_not_break_a_run(spark):
    rows = spark.createDataFrame([("w", 0.0, "A", 60.0), ("w", 5.0, " ", 60.0), ("w", 10.0, "A", 60.0)], "ws string, t double, text string, duration double")
    assert [tuple(r) for r in signals.screen_text_spans(rows, 5.0).collect()] == [("w", 0.0, 15.0, "A")]


def test_labels_between_break_an_event(spark):
    rows = spark.createDataFrame([("w", "laugh", 0.0, 1.0), ("w", "clap", 1.0, 1.0), ("w", "laugh", 2.0, 1.0)], "ws string, label string, t double, conf double")
    assert signals.audio_events(rows).count() == 3


def test_kept_scene_moves(spark):
    rows = spark.createDataFrame([("w", 0.0, 0.4), ("w", 0.9, 0.5), ("w", 1.8, 0.6)], "ws string, t double, score double")
    assert [tuple(r) for r in signals.suppress_scenes(rows).collect()] == [("w", 1.8, 0.6)]


def test_first_region_stays_however_short(spark):
    rows = [("w", k, k * 0.25, roi, n, float(roi == ("a" if k < 1 else "b"))) for k in range(12) for n, roi in enumerate("ab")]
    df = spark.createDataFrame(rows, "ws string, idx int, t double, roi string, roi_order int, motion double")
    assert [(r["roi"], r["s"], r["e"]) for r in signals.active_regions(df, 0.25).orderBy("s").collect()] == [("a", 0.0, 0.25), ("b", 0.25, 3.0)]


def test_histogram_of_plain_colors(spark):
    rgb = bytes([255, 0, 0] * 3 + [0, 255, 0])
    hist = signals.hs_histogram(spark.createDataFrame([("w", 0, rgb), ("w", 1, b"")], "ws string, idx int, rgb binary")).orderBy("idx").collect()
    assert sorted(x for x in hist[0]["hist"] if x) == [0.25, 0.75] and len(hist[0]["hist"]) == 36 * 32 and sum(hist[1]["hist"]) == 0


def test_rolling_cues(spark):
    words = "one two three four five six seven eight".split()
    cues = [("w", float(k), k + 2.0, " ".join(words[k : k + 3])) for k in range(6)] + [("w", 40.0, 41.0, "other text"), ("w", 41.0, 42.0, "other text")]
    out = transcript.dedupe_rolling(spark.createDataFrame(cues, "ws string, s double, e double, text string")).orderBy("s").collect()
    assert [(r["s"], r["e"], r["text"]) for r in out] == [(0.0, 7.0, " ".join(words)), (40.0, 42.0, "other text")]
    late = [("w", 0.0, 1.0, "a b c"), ("w", 20.0, 21.0, "c d"), ("w", 30.0, 31.0, "d")]
    out = transcript.dedupe_rolling(spark.createDataFrame(late, "ws string, s double, e double, text string")).orderBy("s").collect()
    assert [(r["s"], r["e"], r["text"]) for r in out] == [(0.0, 1.0, "a b c"), (20.0, 31.0, "c d")]


def brute_keyframes(rows, budget, duration):
    """Merge rows (t, weight, source) in order into the first within half a second; then pick again and again the one of greatest gain."""
    kept = []
    for t, w, source in rows:
        near = [k for k in kept if abs(k[0] - t) <= 0.5]
        if near:
            near[0][1] = max(near[0][1], w)
            near[0][2] += [source] * (source not in near[0][2])
        else:
            kept.append([t, w, [source]])
    names = {round(t, 2): (w, "+".join(n)) for t, w, n in kept}
    left, picks, why = sorted((round(t, 2), w) for t, w, _ in kept), [], {}
    while left and len(picks) < budget:
        gain = lambda c: c[1] + 0.5 * (min(min(abs(c[0] - p) for p in picks) / (duration / budget), 1.0) if picks else 1.0)
        best = max(left, key=lambda c: (gain(c), -c[0]))
        picks.append(best[0])
        why[best[0]] = (None, None)
        for c in left:
            if c != best and abs(c[0] - best[0]) < 1.0:
                why[c[0]] = ("min_gap_displaced", best[0])
        left = [c for c in left if c[0] not in why]
    why |= {c[0]: ("budget_exhausted", None) for c in left}
    return {t: (*names[t], *w) for t, w in why.items()}


def test_keyframes_equal_brute_force(spark):
    rng = random.Random(4)
    rows = {w: [(k, rng.choice([rng.uniform(0, 40), rng.randint(0, 79) / 2, 20 + k % 7 / 4]), rng.randint(1, 32) / 32, rng.choice("abc")) for k in range(70)] for w in range(6)}
    rows[6] = [(0, 1.0, 0.5, "a"), (1, 1.6, 0.5, "b"), (2, 1.4, 0.75, "c")]  # the third is nearer to the second, and joins the first
    pool = spark.createDataFrame([(w, t, x, s, 0, float(k), 0) for w, v in rows.items() for k, t, x, s in v], "ws long, t double, weight double, source string, rank int, pos double, turn int")
    videos = spark.createDataFrame([(w, 40.0) for w in rows], "ws long, duration double")
    found = images.select_keyframes(pool.repartition(3), videos, 8).collect()
    for w, v in rows.items():
        want = brute_keyframes([(t, x, s) for _, t, x, s in v], 8, 40.0)
        assert {r["t"]: (r["weight"], r["source"], r["reason"], r["displaced_by"]) for r in found if r["ws"] == w} == want
    assert {(r["t"], r["source"]) for r in found if r["ws"] == 6} == {(1.0, "a+c"), (1.6, "b")}
    assert images.select_keyframes(pool, videos, 0).collect() == [] and images.select_keyframes(pool.limit(0), videos, 8).collect() == []


def test_mixed_sequences_equal_a_plain_fold(spark):
    rng = random.Random(9)
    cut = [(0.0, 1.0, 1, ["cp"], [])]
    rows = [("w", k, f"seq-{rng.randint(0, 20):03d}", "x", rng.choice(list(sequences.RANKS)), cut, 9.0, rng.random() < 0.3) for k in range(300)]
    df = spark.createDataFrame(rows, "ws string, line_no long, seq_id string, intent string, status string, cuts array<struct<s:double,e:double,ord:long,cp_ids:array<string>,signals:array<string>>>, duration double, legacy boolean")
    want, held = {}, {}
    for _, k, seq, _, status, _, _, legacy in rows:
        rank, older = held.get(seq, (-1, True))
        if (legacy and older) or sequences.RANKS[status] >= rank:
            held[seq], want[seq] = (sequences.RANKS[status], legacy), (k, status)
    assert {r["seq_id"]: (r["line_no"], r["status"]) for r in sequences.latest_mixed(df).collect()} == want


def test_times(spark):
    rows = spark.createDataFrame([("12.5",), ("1:23.5",), ("01:02:03.25",), ("1:2:3:4",), ("-1",), ("x",)], "t string")
    assert [r[0] for r in rows.select(tm.parse_ts(F.col("t"))).collect()] == [12.5, 83.5, 3723.25, None, None, None]
    one = spark.range(1)
    assert one.select(tm.frame_clock(F.lit(3600.0), F.lit(30000), F.lit(1001))).first()[0] == "00:59:56:12"
    assert one.select(tm.fmt_ts(F.lit(3723.2506)), tm.fmt_ts_compact(F.lit(83.5)), tm.fmt_ts_compact(F.lit(3723.5)), tm.fmt_ts_compact(F.lit(45296.0)), tm.srt_ts(F.lit(0.0))).first()[:] == ("01:02:03.251", "01:23.500", "1:02:03.500", "12:34:56.000", "00:00:00,000")
    assert one.select(tm.frames(F.lit(0.5), F.lit(25), F.lit(1)), tm.frames(F.lit(0.7), F.lit(25), F.lit(1))).first()[:] == (12, 18) and (tm.nominal_rate(25, 2), tm.nominal_rate(30000, 1001)) == ((12, 1), (30000, 1001))
    rates = spark.createDataFrame([("30000/1001",), ("50/2",), ("29.97",), ("25",), ("0/0",)], "r string").select(tm.frame_rate(F.col("r")).alias("x")).collect()
    assert [None if r["x"] is None else tuple(r["x"]) for r in rates] == [(30000, 1001), (25, 1), (30000, 1001), (25, 1), None]
    assert one.select(tm.human_bytes(F.lit(512)), tm.human_bytes(F.lit(1536)), tm.file_category(F.lit("clips/a.json")), tm.file_category(F.lit("a/b.PNG"))).first()[:] == ("512 B", "1.5 KB", "clips", "captures")


def test_text(spark):
    one = spark.range(1)
    assert one.select(tx.nfc(F.lit("é")), tx.fold(F.lit("ÉtÉ")), tx.ellipsize(F.lit("one two, three"), 9), tx.file_stem(F.lit("a/b_c-d.e.mp4"))).first()[:] == ("é", "ete", "one two…", "b c d e")
    assert one.select(tx.link_targets(F.lit("[a](b.md#x) [c](<d (e).md>) [f](http://g.md) [h](i.txt)"))).first()[0] == ["b.md", "d (e).md"]
    assert one.select(tx.clauses(F.lit("A b (c d). E, f"), True), tx.clauses(F.lit("A b (c d). E, f"), False)).first()[:] == (["A b", "E, f", "c d"], ["A b (c d)", "E", "f"])
    assert one.select(tx.strip_suffix(F.lit("walks"), ["s", "ks"]), tx.strip_suffix(F.lit("as"), ["s"]), tx.repetition_ratio(F.lit("a " * 9 + "b c d"))).first()[:] == ("wal", "as", 0.75)


def test_clauses_and_cuts_of_other_scripts(spark):
    one = spark.range(1)
    text = F.lit("요격은 확정，추진은 후보。 다음 — 끝, 또")
    assert one.select(tx.clauses(text, True), tx.clauses(text, False)).first()[:] == (["요격은 확정，추진은 후보", "다음", "끝, 또"], ["요격은 확정", "추진은 후보", "다음", "끝", "또"])
    assert one.select(*[tx.ellipsize(F.lit(x), 10) for x in ("0123456789", "0123456789a", "ab cdefghijkl", "abcdefg hi jk", "a" * 9 + "—b c")]).first()[:] == ("0123456789", "0123456789…", "ab cdefghi…", "abcdefg hi…".replace(" hi…", "…"), "aaaaaaaaa…")


def test_slugs_never_meet(spark):
    for labels in (["a", "A!", "a 2"], ["b", "b 2", "b!", "b 2!", "B?"], ["x", "y"], ["c 2", "c 2 2", "c", "c!"]):
        rows = knowledge.unique_slugs(spark.createDataFrame([(x,) for x in labels], "label string"), tx.slug(F.col("label"))).collect()
        used, want = set(), {}
        for label in sorted(labels):
            base = "-".join("".join(c if c.isalnum() else " " for c in label.lower()).split())
            name = next(n for n in [base, *[f"{base}-{k}" for k in range(2, 99)]] if n not in used)
            used.add(name)
            want[label] = name
        assert {r["label"]: r["slug"] for r in rows} == want


def test_files(spark, tmp_path):
    ws = tmp_path / "grp" / "video one"
    ws.mkdir(parents=True)
    (tmp_path / "solo").mkdir()
    (ws / "manifest.json").write_text(json.dumps({"duration": 60.0, "fps": 25.0, "has_audio": True, "chapters": [{"start": 0, "end": 5, "title": "x"}]}))
    (tmp_path / "solo" / "manifest.json").write_text("{broken")
    (ws / "transcript.json").write_text(json.dumps([{"id": 3.0, "start": 0, "end": 1, "text": "a"}, {"start": 5, "end": 4, "text": "bad"}, {"id": "3", "start": 1, "end": 2, "text": "b"}, {"start": 2, "end": 3, "text": "c"}, {"id": True, "start": 1, "end": 2, "text": "d"}]))
    (ws / "checkpoints.jsonl").write_bytes(b'{"id": "a", "span": [0, 5], "status": "verified", "hypothesis": "h", "visual_evidence": []}\n\n{nope\n[1]\n{"id": "\xff"}\n{"id": "b", "span": [1, 2], "status": "draft", "hypothesis": "h \xef\xbf\xbd", "speakers": [{"label": " Ann "}, "Bo"]}')
    (ws / "a.en.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.500\n<b>Hello</b>\nthere\n\nNOTE x\n\n2\n01:00:00,5 --> 01:00:01,000\nBye\n")
    (ws / "a.ko.srt").write_text(" ")
    (ws / "title.txt").write_text(" A title \n")
    (ws / "uploader.txt").write_text("NA")
    (ws / "page.md").write_text("[x](y.md)")
    root = str(tmp_path)
    videos = {r["ws"]: r for r in readers.read_videos(spark, root).collect()}
    assert set(videos) == {"grp/video one", "solo"} and videos["grp/video one"]["duration"] == 60.0 and videos["grp/video one"]["grp"] == "grp" and videos["solo"]["duration"] is None
    assert [(r["id_kind"], r["id_key"], r["text"]) for r in readers.read_segments(spark, root).orderBy("pos").collect()] == [("number", "3", "a"), ("string", "3", "b"), ("number", "3", "c"), (None, None, "d")]
    lines, rejects = readers.read_ledger(spark, root, "checkpoints.jsonl")
    assert [r["line_no"] for r in lines.orderBy("line_no").collect()] == [1, 6]
    assert [(r["line_no"], r["reason"]) for r in rejects.orderBy("line_no").collect()] == [(3, "not JSON"), (4, "not JSON"), (5, "not UTF-8")]
    c = readers.claims(lines, readers.read_videos(spark, root)).orderBy("line_no")
    assert [(r["cp_id"], r["s"], r["e"], r["has_visual"], r["duration"]) for r in c.collect()] == [("a", 0.0, 5.0, True, 60.0), ("b", 1.0, 2.0, False, 60.0)]
    assert [r["reason"] for r in ledger.validated(c).orderBy("line_no").collect()] == [None, "status"]
    assert [r[0] for r in c.select(readers.flatten_labels(F.col("speakers"))).collect()] == [[], ["Ann", "Bo"]]
    captions = readers.whole(spark, root, "*.{vtt,srt}")
    assert readers.pick_caption(captions).first()["file"] == "a.ko.srt"
    assert [(r["s"], r["e"], r["text"]) for r in readers.parse_captions(captions).orderBy("s").collect()] == [(1.0, 2.5, "Hello there"), (3600.5, 3601.0, "Bye")]
    assert [(r["field"], r["text"]) for r in readers.read_priors(spark, root).collect()] == [("title", "A title")]
    assert [tuple(r) for r in readers.read_pages(spark, root).collect()] == [("grp/video one/page.md", "[x](y.md)")]
    assert sorted({(r["ws"], r["path"]) for r in readers.file_inventory(spark, root).collect()}) == [("grp/video one", x) for x in sorted(["a.en.vtt", "a.ko.srt", "checkpoints.jsonl", "manifest.json", "page.md", "title.txt", "transcript.json", "uploader.txt"])] + [("solo", "manifest.json")]
    probe = json.dumps({"streams": [{"codec_type": "audio"}, {"codec_type": "video", "width": 4, "height": 2, "avg_frame_rate": "30000/1001", "r_frame_rate": "30/1"}], "format": {"duration": "9.5"}, "chapters": [{"start_time": "0.00049", "end_time": "1", "tags": {"title": "t"}}]})
    found = readers.normalize_probe(spark.createDataFrame([("w", probe), ("x", '{"streams": []}')], "ws string, value string")).orderBy("ws").collect()
    assert (found[0]["duration"], found[0]["vfr"], found[0]["has_audio"], found[0]["error"], found[1]["error"]) == (9.5, True, True, None, "no video stream") and abs(found[0]["fps"] - 29.97) < 0.001
    out = str(tmp_path / "out")
    readers.write_table(c.select("ws", "cp_id"), out, "json")
    assert spark.read.json(out).count() == 2


def test_strip_plan(spark):
    d = spark.createDataFrame([("a", 224.0), ("b", 10.0), ("c", 0.0)], "ws string, duration double")
    rows = summary.strip_plan(d).orderBy("ws", "strip").collect()
    assert [(r["ws"], r["s"], r["e"], r["cells"]) for r in rows] == [("a", 0.0, 112.0, 16), ("a", 112.0, 224.0, 16), ("b", 0.0, 10.0, 2)]
    assert rows[2]["mids"] == [2.5, 7.5] and rows[1]["mids"][0] == 115.5


def test_equal_strips_take_little_room(spark, tmp_path):
    """Windows of videos of one length stand next to each other, in files that their dictionary of times fits in."""
    d = spark.range(12_000).selectExpr("id AS ws", "1100 + (id * 7919 % 1000) / 64D AS duration")
    size = lambda df, name: df.write.parquet(f"{tmp_path}/{name}") or sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    plan = summary.strip_plan(d)
    assert 5 * size(plan, "plan") < size(plan.orderBy(F.hash("ws", "strip")), "mixed")
    assert spark.read.parquet(f"{tmp_path}/plan").count() == 12_000 * 10


def test_late_rows_are_dropped_and_windows_close(spark, tmp_path):
    schema = "ts timestamp, ws long, value long"
    for k, hours in enumerate([[0, 1], [60], [61], [2], [100]]):  # hour 2 comes when its day is closed; the filter is a batch behind
        spark.createDataFrame([(h,) for h in hours], "h int").selectExpr("timestamp_seconds(h * 3600) AS ts", "1L AS ws", "1L AS value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    out = jobs.drain(jobs.loudness(stream), f"file://{tmp_path}")
    assert {r["start"].isoformat(): r["n"] for r in out.collect()} == {"1970-01-01T00:00:00": 2, "1970-01-03T00:00:00": 2}


def test_changed_timelines_alone_are_rebuilt(spark, tmp_path):
    seen = []
    for k, size in enumerate((1, 1, 2)):
        spark.createDataFrame([(w, "p", size if w == 1 else 1, "2020-01-01") for w in (1, 2)], "ws long, path string, size long, mtime string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        files = spark.readStream.schema("ws long, path string, size long, mtime string").parquet(str(tmp_path / "in"))
        jobs.drain_each(jobs.changed_timelines(files), str(tmp_path), lambda batch, _: seen.append(sorted(r["ws"] for r in batch.collect())), str(tmp_path / "log"))
    assert [x for x in seen if x] == [[1, 2], [1]]


def test_streams_go_on_after_a_restart(spark, tmp_path):
    """Each time a new run: Spark's state and the changes so far are found by their folder alone."""
    rows = log(spark, [("hypothesized", 0.0, 1.0), ("verified", 1.0, 2.0), ("hypothesized", 3.0, 4.0), ("verified", 9.0, 1.0), ("corrected", 5.0, 6.0), ("hypothesized", 7.0, 8.0)])
    steps = [("assembled", True), ("approved", True), ("proposed", True), ("assembled", False), ("proposed", False), ("assembled", True)]
    lines = spark.createDataFrame([("w", "seq-001", k, status, sequences.RANKS[status], legacy, True) for k, (status, legacy) in enumerate(steps, 1)], "ws string, seq_id string, line_no long, status string, rank int, legacy boolean, strict boolean")
    want = [1, 2, 3, 3, 5, 5]  # older lines go back until one of today's form is accepted
    for k in range(1, 7):
        for name, df in (("claims", rows), ("sequences", lines)):
            df.filter(F.col("line_no") == k).write.mode("append").parquet(str(tmp_path / name))
        stream = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
        got = jobs.drain_updates(jobs.latest_claims(stream("claims", rows)), ["ws", "cp_id"], "", str(tmp_path / "a"))
        names = sorted(rows.columns)
        assert got.select(names).collect() == ledger.latest(rows.filter(F.col("line_no") <= k)).select(names).collect()
        got = jobs.drain_updates(jobs.latest_sequences(stream("sequences", lines)), ["ws", "seq_id"], "", str(tmp_path / "b"))
        assert [r["line_no"] for r in got.collect()] == [want[k - 1]]


def test_segments_are_cut_at_pauses_and_numbered(spark):
    seg = spark.createDataFrame([("w", 0, 0.0, 9.0, "a b c", 0.5), ("w", 1, 10.0, 12.0, "lone", None), ("w", 2, 20.0, 22.0, "none", 0.1)], "ws string, pos int, s double, e double, text string, conf double")
    words = spark.createDataFrame([("w", 0, 0.0, 1.0, " a", 0.5), ("w", 1, 1.5, 2.0, " b", 1.0), ("w", 2, 3.6, 4.0, " c", None), ("w", 3, 10.0, 11.0, "lone", 0.9)], "ws string, k int, s double, e double, word string, p double")
    out = transcript.split_segments(seg, words).orderBy("id").collect()
    assert [tuple(r)[1:] for r in out] == [(0, 0.0, 2.0, "a b", 0.75), (1, 3.6, 4.0, "c", 0.0), (2, 10.0, 12.0, "lone", None), (3, 20.0, 22.0, "none", 0.1)]


def test_intent_terms_are_found_across_pieces(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab ") for _ in range(n)) for n in (0, 1, 5, 40, 700)]
    seg = spark.createDataFrame([("w", k, float(k), t) for k, t in enumerate(texts)] + [("w", 9, 9.0, None)], "ws string, pos int, s double, folded string")
    terms = [(q, "".join(rng.choice("ab ") for _ in range(rng.randint(1, 7)))) for q in range(30) for _ in range(4)]
    got = search.intent_hits(seg, spark.createDataFrame(terms, "query int, term string"), 99, 8).collect()
    want = {(q, k): n for q in range(30) for k, t in enumerate(texts) if (n := len({x for y, x in terms if y == q and len(x) > 1 and x in t}))}
    assert {(r["query"], r["pos"]): r["n"] for r in got} == want


def test_results_do_not_depend_on_row_order(spark, tiny):
    hits = view(spark, tiny, "v_hits")
    a = signals.audio_events(hits).collect()
    b = signals.audio_events(hits.orderBy(F.rand(3)).repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert np.all([r["s"] < r["e"] for r in a])


def test_alias_leaders_equal_a_greedy_pass(spark, tmp_path):
    rng = random.Random(7)
    names = sorted({" ".join(rng.sample(["red", "blue", "cold", "old", "big", "bolt", "rod", "gear"], rng.randint(1, 4))) for _ in range(60)})
    labels = spark.createDataFrame([(n,) for n in names], "label string")
    pairs = knowledge.alias_pairs(labels)
    alike = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())) >= 0.5
    want, leaders = {}, []
    for n in names:
        want[n] = next((x for x in leaders if alike(n, x)), n)
        if want[n] == n:
            leaders.append(n)
    assert {r["label"]: r["leader"] for r in knowledge.alias_leaders(labels, pairs, f"file://{tmp_path}").collect()} == want


def test_windows_are_narrowed_to_the_member_that_says_it(spark):
    docs = spark.createDataFrame([("t", "w1", 1, "window", 0.0, 9.0, [(0.0, 3.0, "one thing"), (3.0, 6.0, "thing and thing"), (6.0, 9.0, "Thing thing Thing")]), ("t", "t2", 1, "transcript", 3.0, 6.0, [])], "family string, doc string, ws int, source string, s double, e double, members array<struct<s:double,e:double,text:string>>")
    hits = spark.createDataFrame([(1, "t", "w1", 2.0, 1), (1, "t", "t2", 1.0, 2)], "query int, family string, doc string, score double, place long")
    out = search.narrowed(hits, docs, spark.createDataFrame([(1, "thing")], "query int, term string")).collect()
    assert [(r["source"], r["s"], r["e"], r["place"]) for r in out] == [("transcript", 3.0, 6.0, 1)]


def test_phrases_and_parts_of_words(spark):
    texts = ["the state of the art", "State, often", "of state", "state-of-mind; state of play", "état_of", "in-state of", "a CAPital Thing", "stateofthings"]
    docs = spark.createDataFrame([("f", str(k), t) for k, t in enumerate(texts)] + [("g", "g0", "state of")], "family string, doc string, text string").withColumn("folded", tx.fold(F.col("text")))
    asked = {"state-of": {"0", "1", "3", "5", "g0"}, "STATE of": {"0", "2", "3", "5", "1", "g0"}, "of-the": {"0"}, "the-state-of-th": {"0"}, "etat.": {"4"}, "--- art": {"0"}, "---": set(), "state-of-min": {"3"}, "of-of": set()}
    terms = spark.createDataFrame([(q, t) for q in asked for t in q.split()], "query string, term string")
    found = {}
    for r in search.bm25(docs, terms, 40).collect():
        found.setdefault(r["query"], set()).add(r["doc"])
    assert {q: found.get(q, set()) for q in asked} == asked
    texts = dict([*zip(map(str, range(8)), texts), ("g0", "state of")])
    asked = {q: {d for d, t in texts.items() if q in t} for q in ("APita", "apita", "tateo", "a CAP", "zz", "t", "at_o", "-of-")}
    assert asked["APita"] == {"6"} and not asked["apita"] and len(asked["t"]) > 7
    terms = spark.createDataFrame([(q, q) for q in asked], "query string, term string")
    found = {}
    for r in search.substring_rank(docs, terms, spark.createDataFrame([], "query string, family string"), 40).collect():
        found.setdefault(r["query"], set()).add(r["doc"])
        assert r["score"] == texts[r["doc"]].count(r["query"])
    assert {q: found.get(q, set()) for q in asked} == asked


def test_one_word_queries_search_no_windows(spark):
    none, both = [], [(0.0, 1.0, "one word"), (1.0, 2.0, "two")]
    rows = [("f", "a", 1, "transcript", 0.0, 1.0, "one word", none), ("f", "b", 1, "transcript", 1.0, 2.0, "two", none), ("f", "w", 1, "window", 0.0, 2.0, "one word two", both)]
    docs = spark.createDataFrame(rows, "family string, doc string, ws int, source string, s double, e double, text string, members array<struct<s:double,e:double,text:string>>").withColumn("folded", tx.fold(F.col("text")))
    terms = spark.createDataFrame([("x", "two"), ("y", "word"), ("y", "two"), ("z", "absent")], "query string, term string")
    got = sorted((r["query"], r["source"], r["s"], r["place"]) for r in search.search(docs, terms).collect())
    assert got == [("x", "transcript", 1.0, 1), ("y", "transcript", 0.0, 1)]
    assert search.search(docs, terms.limit(0)).collect() == []


def test_links_with_balanced_parentheses(spark):
    one = spark.range(1)
    text = "[z](f((g)).md) [a]( b c.md ) [w](< d e.md#x >) [s](http://x/y.md) [i](k.txt) [n]([m](in.md)) [open](never.md [q](lost.md"
    want = [("f((g)).md", "f((g)).md"), (" b c.md ", None), ("< d e.md#x >", "d e.md"), ("[m](in.md)", "[m](in.md)")]
    got = one.select(tx.page_links(F.lit(text))).first()[0]
    assert [(r["raw"], r["target"]) for r in got if r["raw"] != "[m](in.md)"] == want[:3]
    assert one.select(tx.link_destinations(F.lit(text))).first()[0] == ["f((g)).md", " b c.md ", "< d e.md#x >", "http://x/y.md", "k.txt", "[m](in.md)"]
    for page, target, path in (("a/b.md", "c.md", "a/c.md"), ("a/b.md", "../c/./d.md", "c/d.md"), ("b.md", "../../x.md", "x.md"), ("a/b.md", "/x/../y.md", "/y.md")):
        assert one.select(tx.beside(F.lit(page), F.lit(target))).first()[0] == path
    pages = spark.createDataFrame([("INDEX.md", "[a](a.md)"), ("a.md", ""), ("b.md", "[c](c.md)"), ("c.md", "[b](b.md)")], "page string, text string")
    links = knowledge.link_rows(pages)
    got = knowledge.orphan_pages(links, pages, pages.filter("page = 'INDEX.md'").select("page"), folder(spark)).collect()
    assert sorted(r["page"] for r in got) == ["b.md", "c.md"]


def test_reachable_in_blocks(spark, monkeypatch):
    """Depths are those of a walk breadth first whatever the blocks, and a long chain takes a round a block."""
    rng, rounds = random.Random(5), []
    chain = [(k, k + d) for k in range(600) for d in (1, 3) if k % 7 or d == 1]
    wild = [(rng.randrange(300), rng.randrange(330)) for _ in range(500)] + [(0, k) for k in range(0, 300, 4)] + [(5, None)]
    names = [(f"p{a:03d}", f"p{b:03d}") for a, b in chain[:400]] + [("p390", "p002")]
    kept = knowledge.saved
    monkeypatch.setattr(knowledge, "saved", lambda df, name="table": rounds.append(name) or kept(df, name))
    for links, root, size in ((chain, 0, 100), (wild, 0, 40), (names, "p000", 150)):
        near, want, front = {}, {root: 0}, [root]
        for a, b in links:
            near.setdefault(a, []).append(b)
        for a in front:  # which grows
            for b in near.get(a, ()):
                if b not in want:
                    want[b] = want[a] + 1
                    front.append(b)
        kind = "string" if root == "p000" else "long"
        table, roots = spark.createDataFrame(links, f"src {kind}, dst {kind}"), spark.createDataFrame([(root,)], f"page {kind}")
        rounds.clear()
        assert {r["page"]: r["depth"] for r in knowledge.reachable(table, roots, folder(spark), size).collect()} == want
        assert links is not chain or rounds.count("changed") <= len(chain) // size + 3
    assert knowledge.reachable(table, roots.limit(0), folder(spark)).count() == 0


def test_orphans_of_a_long_chain(spark):
    """A chain of pages takes no round a link."""
    links, pages = spark.createDataFrame([(k, k + 1) for k in range(100)], "src long, dst long"), spark.range(103).toDF("page")
    spark.sparkContext.setJobGroup("orphans", "orphans")
    found = sorted(r["page"] for r in knowledge.orphan_pages(links, pages, pages.filter("page = 10"), folder(spark)).collect())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == [*range(10), 101, 102]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("orphans")) < 90


def test_labels_and_texts_at_any_depth(spark):
    cases = {'[["a",{"label":"b"}],"c"]': ["a", "b", "c"], '{"label":["a"]}': [], '{"label":"x","y":{"label":"z"}}': ["x"], "plain": ["plain"], "[draft": ["[draft"], "[draft]": ["[draft]"], "": [], '[[[["d"]]],1,null,true]': ["d"], '["q\\"]}","\\u00e9"]': ['q"]}', "é"]}
    rows = spark.createDataFrame([(x,) for x in [*cases, None]], "x string").select("x", readers.flatten_labels(F.col("x")).alias("labels"), lb.said(F.col("x")).alias("said")).collect()
    assert {r["x"]: r["labels"] for r in rows} == cases | {None: []}
    assert [r["said"] for r in rows if r["x"] == '{"label":"x","y":{"label":"z"}}'] == ["x z"]
    long = '["' + "a" * 200_000 + '"]'
    assert len(spark.createDataFrame([(long,)], "x string").select(readers.flatten_labels(F.col("x"))).first()[0][0]) == 200_000


def test_ids_of_payloads(spark):
    pairs = [('{"a":3,"b":"é"}', '{"b": "e\u0301", "a": 3.0}', True), ('"3"', "3", False), ("[1,[2.5]]", "[1.0, [2.50]]", True), ("0", "-0.0", True), ("true", "1", False), ('"ann"', '"bob"', False)]
    for a, b, same in pairs:
        x, y = spark.range(1).select(lb.stable_id("edge", F.lit(a)), lb.stable_id("edge", F.lit(b))).first()
        assert (x == y) == same and len(x) == 21
    assert spark.range(1).select(lb.stable_id("edge", F.lit("no json")), lb.stable_id("edge", F.lit("[1e999]"))).first()[:] == (None, None)


def test_values_that_cannot_be_read_stop_no_job(spark):
    big = "9" * 30
    probe = lambda **x: json.dumps({"streams": [{"codec_type": "video", "width": 4, "height": 2, "avg_frame_rate": "30000/1001", "r_frame_rate": "30/1"} | x], "format": {"duration": x.get("duration", "9.5")}, "chapters": [{"start_time": "N/A", "end_time": "2", "tags": {}}]})
    texts = [probe(), probe(duration="N/A"), probe(avg_frame_rate="N/A"), probe(avg_frame_rate="30/x"), probe(avg_frame_rate=big), probe(codec_type="audio"), "no json", "{}"]
    rows = readers.normalize_probe(spark.createDataFrame(list(enumerate(texts)), "ws int, value string")).orderBy("ws").collect()
    assert [r["error"] for r in rows][:6] == [None, "no duration", None, None, None, "no video stream"] and rows[6]["error"] and rows[7]["error"]
    assert rows[0]["rate"] == "30000/1001" and rows[2]["fps"] == rows[3]["fps"] == 0.0 and rows[0]["chapters"][0]["start"] == 0.0
    one = spark.range(1)
    assert one.select(tm.frame_rate(F.lit(big)), tm.frame_rate(F.lit(f"{big}/1001")), tm.frame_rate(F.lit("N/A")), lb.parse_roi(F.lit(f"1,2,3,{big}")), lb.parse_roi(F.lit("1,2,3,x"))).first()[:] == (None,) * 5
    assert one.select(lb.parse_roi(F.lit("1,2,3,4"))).first()[0]["w"] == 3
    paths = spark.createDataFrame([(f"t{big}.jpg",), (f"strip_000000001_000000002_n{big}.jpg",), ("t000012500.jpg",), (None,)], "path string")
    assert [r["t"] for r in images.frame_fields(paths).collect()] == [None, None, 12.5, None]


def test_leaders_of_any_group_size_equal_the_greedy_pass(spark):
    rng = random.Random(6)
    labels = sorted({" ".join(rng.choice(["a", "B", "b", "c", "d", "(x)", "e"]) for _ in range(rng.randint(1, 4))) for _ in range(90)})
    import re

    tokens = {x: set(re.sub(r"\([^)]*\)", " ", x).split()) or {x} for x in labels}
    want, leader = {}, {}
    for k, a in enumerate(labels):
        if a not in leader:
            leader[a] = a
            for b in labels[k + 1 :]:
                if b not in leader and len(tokens[a] & tokens[b]) / len(tokens[a] | tokens[b]) >= 0.5:
                    leader[b] = a
        want[a] = leader[a]
    frame = spark.createDataFrame([(x,) for x in labels], "label string")
    pairs = saved(knowledge.alias_pairs(frame))
    for group in (10**6, 12, 0):
        assert {r["label"]: r["leader"] for r in knowledge.alias_leaders(frame, pairs, folder(spark), group).collect()} == want


def test_qualifiers(spark):
    ledger_ = spark.createDataFrame([("w", "facts are likely"), ("w", "other thing"), ("w", "thing likely"), ("w", "unlikely sign")], "ws string, clause string")
    only = knowledge.qualified_only(ledger_, ["likely"])
    assert {r["term"] for r in only.collect()} == {"facts", "are", "unlikely", "sign"}
    told = "# facts heading\n(facts note)\n<!-- facts -->\nopening: **facts stand, ok\nFacts elsewhere. artifacts (facts unlikely)\n  the (sign) here"
    rows = spark.createDataFrame([("w", told)], "ws string, text string").select("ws", F.explode(tx.narrative_clauses(F.col("text"), r"\s*opening\s*:")).alias("clause"))
    got = {(r["clause"], r["term"]) for r in knowledge.qualifier_drops(only, rows, ["likely"]).collect()}
    assert got == {("**facts stand", "facts"), ("the  sign  here", "sign")}
    assert spark.range(1).select(tx.lifted(F.lit("a (b (c) d) e) (f"))).first()[0] == ["a   e) (f", "c", "b   d"]


def test_lines_past_assembled_need_claims_that_carry_them(spark):
    cuts = "array<struct<s:double,e:double,ord:long,cp_ids:array<string>,signals:array<string>>>"
    cut = lambda *ids, s=0.0, e=10.0: (s, e, 1, list(ids), ["x"])
    cases = [("approved", [cut("good")], None, True), ("approved", [cut("weak")], None, False), ("approved", [cut("weak")], {"weak": "h"}, True), ("approved", [cut("open")], None, False), ("approved", [cut()], None, False),
             ("assembled", [cut()], None, True), ("assembled", [cut("none")], None, False), ("approved", [cut("good", s=0.0, e=19.0)], None, False), ("approved", [cut("good", "next", s=0.0, e=19.0)], None, True), ("approved", [cut("next")], None, False)]
    rows = [("w", k, f"seq-{k:03d}", "x", status, c, 30.0, False, pins) for k, (status, c, pins, _) in enumerate(cases)]
    lines = spark.createDataFrame(rows, f"ws string, line_no long, seq_id string, intent string, status string, cuts {cuts}, duration double, legacy boolean, pins map<string,string>")
    held = [("good", "verified", True, 0.0, 10.0), ("weak", "verified", False, 0.0, 10.0), ("open", "hypothesized", True, 0.0, 10.0), ("next", "corrected", True, 10.0, 20.0)]
    claims = spark.createDataFrame([("w", *c) for c in held], "ws string, cp_id string, status string, supported boolean, s double, e double")
    assert sorted(r["line_no"] for r in sequences.latest_mixed(lines, claims).collect()) == [k for k, c in enumerate(cases) if c[3]]


def test_shapes_of_sequence_lines(spark):
    alt = "array<struct<s:double,e:double,reason:string>>"
    rows = [(None, None, None), ([(0.0, 1.0, "why")], ["me"], {"cp": "h"}), ([(0.0, 99.0, "why")], [], {}), ([(0.0, 1.0, " ")], [], {}), ([], [""], {}), ([], [], {"cp": " "}), ([(2.0, 1.0, "why")], None, None), ([None], None, None)]
    df = spark.createDataFrame([(k, 9.0, *r) for k, r in enumerate(rows)], f"k int, duration double, alternatives {alt}, overrides array<string>, pins map<string,string>")
    assert [r[0] for r in df.orderBy("k").select(sequences.shape_reason()).collect()] == [None, None, "alternative_span", "alternative_reason", "override", "pin", "alternative_span", "alternative_span"]
    refs = ["cp-1", "a\nb", " ", "a\x0cb", "tab\tis fine", "a\ufffe", "\u2028", None]
    df = spark.createDataFrame([(k, [r]) for k, r in enumerate(refs)] + [(8, []), (9, None)], "k int, refs array<string>")
    assert [r[0] for r in df.orderBy("k").select(sequences.good_refs(F.col("refs"))).collect()] == [True, False, False, False, True, False, False, False, True, True]


def test_pieces_of_any_size_give_the_same_rows(spark, tiny):
    """Scans of long recordings: cut into pieces of a row or two, of a minute, and not at all."""
    rng = random.Random(12)
    hits = [(w, rng.choice("ab"), k * 1.5 + rng.choice([0, 2, 40]), rng.random()) for w in "xy" for k in range(120)]
    hits = spark.createDataFrame(hits, "ws string, label string, t double, conf double")
    loud = spark.createDataFrame([(w, k, k / 2, None if k % 13 == 0 else float(rng.choice([-60, -50, -50, -20, -10, rng.uniform(-60, 0)]))) for w in "xy" for k in range(150)], "ws string, idx int, t double, db double")
    motion = spark.createDataFrame([(w, k, k / 4, roi, n, float(rng.randint(0, 3))) for w in "xy" for k in range(150) for n, roi in enumerate("lr")], "ws string, idx int, t double, roi string, roi_order int, motion double")
    hist = spark.createDataFrame([(w, k, [p, 1 - p]) for w in "xy" for k in range(0, 200, 3) for p in [rng.random()]], "ws string, idx int, hist array<double>")
    edges = spark.createDataFrame([(w, rng.randint(0, 400) / 4) for w in "xy" for _ in range(60)], "ws string, t double").distinct()
    words = spark.createDataFrame([(w, s, s + rng.choice([0.5, 1.0, 7.0]), f"w{k}") for w in "xy" for k in range(50) for s in [rng.randint(0, 380) / 4]], "ws string, s double, e double, word string")
    text = hits.select("ws", "t", F.when(F.col("conf") < 0.2, " ").otherwise(F.col("label")).alias("text"), F.lit(300.0).alias("duration"))
    jobs_ = {
        "audio": lambda p: signals.audio_events(hits, piece=p), "loud": lambda p: signals.loud_spans(loud, top=99, piece=p), "text": lambda p: signals.screen_text_spans(text, 2.0, piece=p),
        "regions": lambda p: signals.active_regions(motion, 0.25, piece=p), "color": lambda p: signals.color_distance(hist, piece=p), "words": lambda p: edits.word_alignment(edges, words, piece=p),
    }
    for name, job in jobs_.items():
        whole, *parts = (sorted(map(repr, job(p).collect())) for p in (1e9, 60.0, 1.25))
        assert len(whole) > 8 and all(x == whole for x in parts), name
