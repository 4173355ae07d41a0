"""Image provenance events: catalog, backlinks, tiers, edges, keyframe choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def catalog(events: DataFrame, existing: DataFrame, fields: list[str]) -> DataFrame:
    """One row per image (ws, image_id) of events (ws, line_no, image_id, path, source, fields): the last value present of each field.

    path: of those that exist (ws, path) the least, else the least; exists and
    tracked if any event is; one sort by (ws, image_id, line_no).
    """
    rows = events.join(existing.select("ws", "path").distinct().withColumn("there", F.lit(True)), ["ws", "path"], "left").fillna(False, ["there"])
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("line_no"))).alias(f) for f in fields]
    best = F.min(F.struct((~F.col("there")).alias("absent"), F.col("path").alias("path")))
    return rows.groupBy("ws", "image_id").agg(best["path"].alias("path"), F.bool_or("there").alias("exists"), F.bool_or(F.col("source") != "inventory").alias("tracked"), *last)


def untracked(files: DataFrame, images: DataFrame) -> DataFrame:
    """(ws, path): frame files that no image has."""
    return files.select("ws", "path").distinct().join(images.select("ws", "path"), ["ws", "path"], "left_anti")


def new_edges(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """incoming events (ws, edge_id, line_no, ...) whose edge is not known (ws, edge_id), the first of each edge."""
    first = F.row_number().over(Window.partitionBy("ws", "edge_id").orderBy("line_no"))
    return incoming.join(known.select("ws", "edge_id").distinct(), ["ws", "edge_id"], "left_anti").withColumn("first", first).filter("first = 1").drop("first")


def backlinks(refs: DataFrame, images: DataFrame) -> DataFrame:
    """(ws, image_id, cp_ids): claims that cite an image (ws, cp_id, first_line, path), in ledger order, each once; path may be an image's path or its id."""
    by_path = refs.select("ws", "cp_id", "first_line", "path").join(images.select("ws", "path", "image_id"), ["ws", "path"]).drop("path")
    by_id = refs.select("ws", "cp_id", "first_line", F.col("path").alias("image_id")).join(images.select("ws", F.col("image_id").cast("string").alias("image_id")), ["ws", "image_id"])
    each = by_path.unionByName(by_id).groupBy("ws", "image_id", "cp_id").agg(F.min("first_line").alias("at"))
    return each.groupBy("ws", "image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cp_id"))), lambda x: x["cp_id"]).alias("cp_ids"))


def tiers(images: DataFrame, links: DataFrame) -> DataFrame:
    """images (ws, image_id, reason) with tier: interpreted (cited), captured (a reason alone) or unsourced."""
    both = images.join(links.select("ws", "image_id", F.lit(True).alias("cited")), ["ws", "image_id"], "left")
    tier = F.when(F.col("cited"), "interpreted").when(F.coalesce(F.col("reason") != "", F.lit(False)), "captured").otherwise("unsourced")
    return both.select("ws", "image_id", tier.alias("tier"))


def counts(images: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """(ws, images, available, tracked, untracked, linked, edges, unsourced): unsourced images have no edge (ws, image_id, edge_id)."""
    n = edges.groupBy("ws", "image_id").agg(F.count_distinct("edge_id").alias("edges"))
    both = images.select("ws", "image_id", "exists", "tracked").join(links.select("ws", "image_id", F.lit(True).alias("linked")), ["ws", "image_id"], "left").join(n, ["ws", "image_id"], "left").fillna(0, ["edges"])
    return both.groupBy("ws").agg(
        F.count("*").alias("images"), F.count_if("exists").alias("available"), F.count_if("tracked").alias("tracked"), F.count_if(~F.col("tracked")).alias("untracked"),
        F.count("linked").alias("linked"), F.sum("edges").alias("edges"), F.count_if(F.col("edges") == 0).alias("unsourced"),
    )


def preferred_reason(events: DataFrame) -> DataFrame:
    """(ws, image_id, reason): the last reason that is not empty."""
    return events.filter("reason IS NOT NULL AND reason <> ''").groupBy("ws", "image_id").agg(F.max_by("reason", "line_no").alias("reason"))


def capture_reasons(images: DataFrame) -> DataFrame:
    """(ws, file, reason): the preferred reason (else '') of images (ws, path, reason) by their path and by its last part; of images that share that, the one of the last path counts."""
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    files = images.filter("path IS NOT NULL").select("ws", "path", F.coalesce("reason", F.lit("")).alias("reason"), F.explode(F.array_distinct(F.array("path", base))).alias("file"))
    return files.groupBy("ws", "file").agg(F.max_by("reason", "path").alias("reason"))


def frame_fields(paths: DataFrame) -> DataFrame:
    """paths (path) with what file names tell: kind, t, span_s, span_e (seconds), cells, cols, version, timestamps, slug.

    Frames are 't<9 digits of milliseconds>', with '_c<8 hex digits>' if cropped;
    strips 'strip_<start>_<end>_n<cells>', with '_c<cols>_v<version>' if known;
    either may end with '-<slug>', and all in '.jpg'. Of up to 16 cells the
    timestamps are their mid-points. Names of another form, and numbers beyond
    a long, give nulls; kind is that of the name's beginning.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    frame, strip = r"^t(\d{9})(_c[0-9a-f]{8})?(?:-([^.]+))?\.jpg$", r"^strip_(\d{9})_(\d{9})_n(\d+)(?:_c(\d+)_v(\d+))?(?:-([^.]+))?\.jpg$"
    part = lambda pattern, k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    number = lambda pattern, k: part(pattern, k).try_cast("long")
    start, end, cells = number(strip, 1) / 1000, number(strip, 2) / 1000, number(strip, 3)
    middles = F.transform(F.sequence(F.lit(0), F.least(cells, F.lit(16)).cast("int") - 1), lambda k: start + (k + 0.5) * (end - start) / cells)
    kind = F.when(name.startswith("strip_"), "filmstrip").when(part(frame, 2).isNotNull(), "frame-crop").otherwise("frame")
    return paths.select(
        "*", kind.alias("kind"), (number(frame, 1) / 1000).alias("t"), start.alias("span_s"), end.alias("span_e"), cells.alias("cells"), number(strip, 4).alias("cols"), number(strip, 5).alias("version"),
        F.when((start < end) & cells.between(1, 16), middles).alias("timestamps"), F.coalesce(part(frame, 3), part(strip, 6)).alias("slug"),
    )


#: Weights of keyframe candidates by signal (fixed values).
SCENE, BURST_MIDDLE, BURST_EDGE, UNSURE_SEGMENT, END_CARD, UNSURE_CLAIM = 0.5, 0.7, 0.55, 0.6, 0.65, 0.7


def candidates(scenes: DataFrame, bursts: DataFrame, claims: DataFrame, segments: DataFrame, videos: DataFrame) -> DataFrame:
    """(ws, t, weight, source, rank, pos, turn): keyframe candidates of all signals, in the order in which they merge (rank, pos, turn).

    scenes (ws, t, score); bursts (ws, s, e), each with its middle and edges in a row; claims (ws, status, confidence, s, e); segments (ws, s, e), uncertain ones; videos (ws, duration).
    """

    def row(df, t, w, source, rank, pos=None, turn=0):
        return df.select("ws", t.alias("t"), w.cast("double").alias("weight"), F.lit(source).alias("source"), F.lit(rank).alias("rank"), (t if pos is None else pos).alias("pos"), F.lit(turn).alias("turn"))

    conf = F.coalesce("confidence", F.lit(0.0))
    middle, start = (F.col("s") + F.col("e")) / 2, F.col("s")
    unsure = claims.filter((F.col("status") != "verified") & (conf < UNSURE_CLAIM))
    out = row(scenes, F.col("t"), SCENE + F.least("score", F.lit(0.5)), "scene", 0)
    out = out.unionByName(row(bursts, middle, F.lit(BURST_MIDDLE), "burst-mid", 1, start, 0)).unionByName(row(bursts, start, F.lit(BURST_EDGE), "burst-edge", 1, start, 1)).unionByName(row(bursts, F.col("e"), F.lit(BURST_EDGE), "burst-edge", 1, start, 2))
    out = out.unionByName(row(unsure, middle, F.least(F.lit(1.0), 0.5 + UNSURE_CLAIM - conf), "cp-uncertain", 2)).unionByName(row(segments, middle, F.lit(UNSURE_SEGMENT), "asr-lowconf", 3))
    out = out.unionByName(row(videos.filter("duration > 1"), F.col("duration") - 1, F.lit(END_CARD), "endcard-rule", 4))
    return out.join(videos.select("ws", "duration"), "ws").filter("t >= 0 AND t <= duration").drop("duration")


def merged_candidates(pool: DataFrame, merge: float = 0.5) -> DataFrame:
    """(ws, t, weight, source): the pool's candidates in order, each joined to the first kept one within `merge` of it, else kept.

    A kept one takes the greatest weight and the names of all that join it.
    Candidates further than `merge` from all others are parted by a window and
    never meet Python; only runs that lie closer are folded, a run to a group.
    """
    by_time = Window.partitionBy("ws").orderBy("t")
    gap = F.coalesce(F.col("t") - F.lag("t").over(by_time) > merge, F.lit(True))
    order = F.struct("rank", "pos", "turn", "t", "weight", "source")
    runs = pool.withColumn("new", gap.cast("int")).withColumn("run", F.sum("new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy("ws", "run").agg(F.array_sort(F.collect_list(order)).alias("c"))
    kept = F.aggregate("c", F.array().cast("array<struct<t:double,weight:double,source:string>>"), lambda a, x: joined_candidate(a, x, merge))
    return each.select("ws", F.explode(F.when(F.size("c") == 1, F.transform("c", lambda x: F.struct(x["t"], x["weight"], x["source"]))).otherwise(kept)).alias("k")).select("ws", "k.*")


def joined_candidate(kept: Column, x: Column, merge: float) -> Column:
    """kept (t, weight, source) in order of insertion, with x joined to the first within `merge` of it, else at the end."""
    at = F.coalesce(F.array_position(F.transform(kept, lambda k: F.abs(k["t"] - x["t"]) <= merge), F.lit(True)), F.lit(0))
    names = lambda k: F.when(F.array_contains(F.split(k["source"], r"\+"), x["source"]), k["source"]).otherwise(F.concat(k["source"], F.lit("+"), x["source"]))
    met = F.transform(kept, lambda k, i: F.when(i + 1 == at, F.struct(k["t"].alias("t"), F.greatest(k["weight"], x["weight"]).alias("weight"), names(k).alias("source"))).otherwise(k))
    return F.when(at > 0, met).otherwise(F.concat(kept, F.array(F.struct(x["t"].alias("t"), x["weight"].alias("weight"), x["source"].alias("source")))))


def select_keyframes(pool: DataFrame, videos: DataFrame, budget: int, merge: float = 0.5, least_gap: float = 1.0, spread: float = 0.5) -> DataFrame:
    """(ws, t, weight, source, reason, displaced_by): the candidates picked (null reason), and why others were not; t to 0.01.

    Of the merged candidates that of greatest weight + spread x (distance to
    picks / ideal gap, 1 at most) is picked, the earliest on ties; those within
    `least_gap` of it fall to it. Picks depend on each other: a fold of
    `budget` steps over a video's candidates, all in column functions.
    """
    shown = F.least(F.greatest(F.bround("t", 2), F.lit(0.0)), F.col("duration"))
    rows = merged_candidates(pool, merge).join(videos.select("ws", "duration"), "ws").withColumn("t", shown)
    kind = "array<struct<t:double,weight:double,source:string,reason:string,displaced_by:double,far:double>>"
    open_ = F.struct("t", "weight", "source", F.lit("open").alias("reason"), F.lit(None).cast("double").alias("displaced_by"), F.lit(None).cast("double").alias("far"))
    videos_ = rows.groupBy("ws", "duration").agg(F.array_sort(F.collect_list(open_)).cast(kind).alias("c"))
    ideal = F.greatest(F.col("duration") / max(budget, 1), F.lit(1e-9))

    def step(c: Column, _: Column) -> Column:
        gain = lambda x: x["weight"] + spread * F.coalesce(F.least(x["far"] / ideal, F.lit(1.0)), F.lit(1.0))
        best = F.element_at(F.array_sort(F.transform(F.filter(c, lambda x: x["reason"] == "open"), lambda x: F.struct((-gain(x)).alias("g"), x["t"].alias("t")))), 1)["t"]
        pick = lambda t: F.transform(c, lambda x: F.struct(
            x["t"].alias("t"), x["weight"].alias("weight"), x["source"].alias("source"),
            F.when((x["reason"] == "open") & (x["t"] == t), F.lit("picked")).when((x["reason"] == "open") & (F.abs(x["t"] - t) < least_gap), F.lit("min_gap_displaced")).otherwise(x["reason"]).alias("reason"),
            F.when((x["reason"] == "open") & (x["t"] != t) & (F.abs(x["t"] - t) < least_gap), t).otherwise(x["displaced_by"]).alias("displaced_by"), F.least(x["far"], F.abs(x["t"] - t)).alias("far"),
        ))
        return F.when(F.exists(c, lambda x: x["reason"] == "open"), F.element_at(F.transform(F.array(best), pick), 1)).otherwise(c).cast(kind)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(budget)), F.col("c"), step) if budget > 0 else F.array().cast(kind)
    each = videos_.select("ws", F.explode(done).alias("x")).select("ws", "x.*")
    return each.select("ws", "t", "weight", "source", F.when(F.col("reason") != "picked", F.when(F.col("reason") == "open", "budget_exhausted").otherwise(F.col("reason"))).alias("reason"), "displaced_by")


def sharpest(requests: DataFrame, scores: DataFrame, width: float) -> DataFrame:
    """(ws, t, at): of t - width, t and t + width (inside [0, duration]) the time of best score (ws, t, score), then the nearest, then the earliest."""
    each = F.array_distinct(F.transform(F.array(F.col("t") - width, F.col("t"), F.col("t") + width), lambda x: F.least(F.greatest(x, F.lit(0.0)), F.col("duration"))))
    rows = requests.select("ws", "t", F.explode(each).alias("at")).join(scores.select("ws", F.col("t").alias("at"), "score"), ["ws", "at"])
    return rows.groupBy("ws", "t").agg(F.min_by("at", F.struct(-F.col("score"), F.abs(F.col("at") - F.col("t")), F.col("at"))).alias("at"))
