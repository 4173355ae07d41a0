"""Events in dense series: loud spans, scene changes, event runs, on-screen text, active regions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def loud_spans(loud: DataFrame, dt: float = 0.5, gap: int = 1, top: int = 5, piece: float = scans.ROWS) -> DataFrame:
    """The `top` loudest spans (ws, s, e, score, peak_db) of each video's series (ws, idx, t, db; idx from 0, t = idx dt).

    Windows at or over max(lower 75 % order statistic, median + 3) join over at
    most `gap` windows between them and are padded by one window; score is the
    sum of what exceeds the median. Fewer than 4 finite values: none. Values
    are ranked by their counts, in pieces of one decibel; runs are found in
    pieces of `piece` windows.
    """
    hot = loud.filter("db IS NOT NULL AND NOT isnan(db)")
    counts = hot.groupBy("ws", "db").agg(F.count("*").alias("n"))
    upto = scans.running(counts, "upto", F.col("n"), ["db"], scans.cut(F.greatest(F.least("db", F.lit(1e6)), F.lit(-1e6)), 1.0), ["ws"])
    ranked = upto.join(counts.groupBy("ws").agg(F.sum("n").alias("all")), "ws")
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("db")))
    n = F.col("all")
    middle = (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2
    limits = ranked.groupBy("ws", "all").agg(at(F.floor(0.75 * (n - 1)) + 1).alias("p75"), middle.alias("median")).filter(n >= 4).select("ws", "median", F.greatest("p75", F.col("median") + 3.0).alias("limit"))
    ends = loud.groupBy("ws").agg(F.max("idx").alias("most"))
    over = hot.join(limits, "ws").filter("db >= limit")
    numbered = scans.runs(over, ["idx"], lambda a, b: b["idx"] - a["idx"] > gap + 1, ["idx"], scans.cut(F.col("idx"), piece), ["ws"])
    spans = numbered.groupBy("ws", "run").agg(F.min("idx").alias("a"), F.max("idx").alias("b"), F.round(F.sum(F.col("db") - F.col("median")), 1).alias("score"), F.round(F.max("db"), 1).alias("peak_db"))
    first, last = F.greatest(F.col("a") - 1, F.lit(0)), F.least(F.col("b") + 1, F.col("most"))
    spans = spans.join(ends, "ws").select("ws", F.round(first * dt, 3).alias("s"), F.round(last * dt + dt, 3).alias("e"), "score", "peak_db")
    best = F.row_number().over(Window.partitionBy("ws").orderBy(F.desc("score"), "s"))
    return spans.withColumn("place", best).filter(F.col("place") <= top).drop("place")


def scene_hits(scores: DataFrame, dt: float | None = None, least: float = 0.3, low: float = 0.04, times: float = 3.0, window_s: float = 2.0, adaptive: bool = True, chunk: int = 8192) -> DataFrame:
    """Frames (ws, idx, t, score; idx from 0, without gaps) that are scene changes: score >= least, or if adaptive >= low and `times` the mean of the previous frames.

    The mean spans the last `window_s` seconds: k frames, at least one, by dt,
    or where that is None by the distance of each video's first two frames
    (0.04 s where it is 0). Videos are cut into pieces of `chunk` frames, each
    with the k frames before it, so that a long one is many tasks.
    """
    if not adaptive:
        return scores.filter(F.col("score") >= least).select("ws", "idx", "t", "score")
    if dt is None:
        at = lambda k: F.max(F.when(F.col("idx") == k, F.col("t")))
        step = F.coalesce(F.nullif(at(1) - at(0), F.lit(0.0)), F.lit(0.04))
        rates = scores.groupBy("ws").agg(F.greatest(F.bround(window_s / step), F.lit(1)).cast("long").alias("k"))
        placed = scores.join(rates, "ws")
    else:
        placed = scores.withColumn("k", F.lit(max(1, round(window_s / dt))).cast("long"))
    size = F.greatest(F.lit(chunk), F.col("k"))
    piece = F.floor(F.col("idx") / size)
    # the last k frames of a piece are read by the next one too
    pieces = F.when(F.col("idx") % size >= size - F.col("k"), F.array(piece, piece + 1)).otherwise(F.array(piece))
    each = placed.withColumn("own", piece).withColumn("piece", F.explode(pieces)).withColumn("u", F.col("idx") / F.col("k"))
    # k frames are 1 in units of u: a range of one unit, with room for rounding
    before = F.expr("avg(score) OVER (PARTITION BY ws, piece ORDER BY u RANGE BETWEEN 1.000001D PRECEDING AND 0.000001D PRECEDING)")
    jump = (F.col("score") >= low) & (F.col("score") >= times * F.col("before"))
    return each.withColumn("before", before).filter((F.col("own") == F.col("piece")) & ((F.col("score") >= least) | jump)).select("ws", "idx", "t", "score")


def suppress_scenes(hits: DataFrame, least_gap: float = 1.0) -> DataFrame:
    """hits (ws, t, score) less than `least_gap` after the one kept: the stronger stays, and the kept one moves.

    A fold in order of time, so each video is one Arrow group (hits are few per video).
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[float, float]] = []
        for t, score in rows.sort_values("t")[["t", "score"]].itertuples(index=False):
            if kept and t - kept[-1][0] < least_gap:
                if score > kept[-1][1]:
                    kept[-1] = t, score
            else:
                kept.append((t, score))
        return pd.DataFrame({"ws": rows["ws"].iloc[0], "t": [x[0] for x in kept], "score": [x[1] for x in kept]})

    kind = hits.schema["ws"].dataType.simpleString()
    return hits.select("ws", "t", "score").groupBy("ws").applyInPandas(fold, f"ws {kind}, t double, score double")


def confirm_by_color(scenes: DataFrame, color: DataFrame, width: float = 0.75, least: float = 0.5) -> DataFrame:
    """scenes (ws, t, ...) with color: greatest distance (ws, t, distance) within `width`, and color_confirmed."""
    from .spans import band_join

    near = band_join(scenes.select("ws", "t"), color.select("ws", F.col("t").alias("rt"), "distance"), width).groupBy("ws", "t").agg(F.max("distance").alias("color"))
    return scenes.join(near, ["ws", "t"], "left").withColumn("color", F.coalesce("color", F.lit(0.0))).withColumn("color_confirmed", F.col("color") >= least)


def audio_events(hits: DataFrame, length: float = 1.5, gap: float = 2.0, piece: float = scans.SECONDS) -> DataFrame:
    """Runs (ws, label, s, e, peak_conf) of hits (ws, label, t, conf), in pieces of `piece` seconds.

    A hit extends the event just before it, whatever its label, only if the
    label is the same and it begins at most `gap` after that event's end.
    """
    changed = lambda a, b: (a["label"] != b["label"]) | (b["t"] - F.round(a["t"] + length, 2) > gap)
    numbered = scans.runs(hits, ["label", "t"], changed, ["t", "label", "conf"], scans.cut(F.col("t"), piece), ["ws"])
    return numbered.groupBy("ws", "run", "label").agg(F.min("t").alias("s"), F.round(F.max("t") + length, 2).alias("e"), F.max("conf").alias("peak_conf")).drop("run")


def screen_samples(lines: DataFrame, least: float = 0.3) -> DataFrame:
    """(ws, t, text): lines (ws, t, k, text, conf, y) read at one time, of confidence `least` or more, from the top (the greatest y) down, then by k; runs of blanks become one."""
    line = F.trim(F.regexp_replace("text", r"\s+", " "))
    placed = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("y"), "k", line.alias("line"))))
    return lines.filter(F.col("conf") >= least).groupBy("ws", "t").agg(F.trim(F.array_join(F.transform(placed, lambda x: x["line"]), " ")).alias("text"))


def screen_text_spans(samples: DataFrame, every: float, piece: float = scans.SECONDS) -> DataFrame:
    """Runs (ws, s, e, text) of equal text over the non-blank samples (ws, t, text, duration), in pieces of `piece` seconds; blanks do not break a run."""
    lines = samples.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).filter("text <> ''")
    numbered = scans.runs(lines, ["text"], lambda a, b: a["text"] != b["text"], ["t", "text"], scans.cut(F.col("t"), piece), ["ws"])
    return numbered.groupBy("ws", "run", "text").agg(F.min("t").alias("s"), F.max(F.least(F.col("t") + every, F.col("duration"))).alias("e")).select("ws", "s", "e", "text")


def active_regions(motion: DataFrame, dt: float, dwell: float = 1.0, piece: float = scans.SECONDS) -> DataFrame:
    """Runs (ws, s, e, roi) of the region with most motion (ws, idx, t, roi, roi_order, motion), first region on ties, in pieces of `piece` seconds.

    Runs shorter than `dwell` join the run kept before them; the first run always stays.
    """
    best = motion.groupBy("ws", "idx", "t").agg(F.min_by("roi", F.struct(-F.col("motion"), F.col("roi_order"))).alias("roi"))
    other = lambda a, b: a["roi"] != b["roi"]
    first = scans.runs(best, ["roi"], other, ["idx"], scans.cut(F.col("t"), piece), ["ws"]).groupBy("ws", "run", "roi").agg(F.min("t").alias("s"), (F.max("t") + dt).alias("e"))
    kept = F.when((F.col("run") == 1) | (F.col("e") - F.col("s") >= dwell), F.col("roi"))
    absorbed = scans.filled(first, {"roi": kept}, {}, ["run"], scans.cut(F.col("s"), piece), ["ws"])
    again = scans.runs(absorbed.drop("run"), ["roi"], other, ["s"], scans.cut(F.col("s"), piece), ["ws"])
    return again.groupBy("ws", "run", "roi").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("ws", "s", "e", "roi")


def hellinger(p: str, q: str):
    """Distance of two histograms (array columns): sqrt(max(0, 1 - sum sqrt(p q)))."""
    shared = F.aggregate(F.zip_with(p, q, lambda a, b: F.sqrt(a * b)), F.lit(0.0), lambda acc, x: acc + x)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - shared))


def color_distance(series: DataFrame, piece: float = scans.ROWS) -> DataFrame:
    """(ws, idx, distance) of each histogram (ws, idx, hist) from the one before, in pieces of `piece` numbers."""
    paired = scans.before(series, "before", F.col("hist"), ["idx"], scans.cut(F.col("idx"), piece), ["ws"])
    return paired.filter("before IS NOT NULL").select("ws", "idx", hellinger("before", "hist").alias("distance"))


def hs_histogram(frames: DataFrame, bins: tuple[int, int] = (36, 32)) -> DataFrame:
    """(ws, idx, hist): hue-saturation histogram, L1-normalised, of each frame's pixels (ws, idx, rgb: binary of 3 bytes a pixel)."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for rgb in rows["rgb"]:
                p = np.frombuffer(rgb or b"", np.uint8).reshape(-1, 3).astype(float) / 255
                top, low = p.max(axis=1, initial=0), p.min(axis=1, initial=1)
                c = np.maximum(top - low, 0)
                r, g, b = p.T if len(p) else np.zeros((3, 0))
                safe = np.where(c > 0, c, 1)
                hue = np.select([c == 0, top == r, top == g], [0, (g - b) / safe % 6, (b - r) / safe + 2], (r - g) / safe + 4) / 6
                h, _, _ = np.histogram2d(hue, np.where(top > 0, c / np.where(top > 0, top, 1), 0), bins=bins, range=((0, 1), (0, 1)))
                out.append((h / max(1, h.sum())).ravel().tolist())
            yield rows[["ws", "idx"]].assign(hist=out)

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    return frames.select("ws", "idx", "rgb").mapInPandas(run, f"ws {kinds['ws']}, idx {kinds['idx']}, hist array<double>")
