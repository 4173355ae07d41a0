"""Queries of spans, ledgers, evidence and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, ledger, signals, spans
from ..sources.tables import saved
from .base import Book

book = Book()

#: SQL of the replay: valid lines after clamping, those accepted, the latest of each claim.
REPLAY = """
c AS (SELECT *, CASE WHEN e > duration AND e - duration <= least(3, greatest(0.05, 0.005 * duration)) THEN duration ELSE e END AS e2 FROM v_cp_log),
ok AS (SELECT * EXCLUDE (e, e2), e2 AS e FROM c WHERE status IN ('hypothesized', 'verified', 'corrected') AND s >= 0 AND s < e2 AND e2 <= duration
       AND (confidence IS NULL OR confidence BETWEEN 0 AND 1)),
acc0 AS (SELECT *, max(CASE WHEN status <> 'hypothesized' THEN 1 ELSE 0 END) OVER (PARTITION BY ws, cp_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS settled FROM ok),
acc AS (SELECT * EXCLUDE (settled) FROM acc0 WHERE status <> 'hypothesized' OR coalesce(settled, 0) = 0),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ws, cp_id ORDER BY line_no DESC) AS rn, min(line_no) OVER (PARTITION BY ws, cp_id) AS first_line FROM acc) WHERE rn = 1)
"""

#: SQL of islands: {src} has ws, s, e inside the bounds.
def islands_sql(src: str, name: str, keys: str = "ws") -> str:
    return f"""
{name}_f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM {src} WHERE s < e),
{name}_n AS (SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_f),
{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {name}_n GROUP BY {keys}, isl)"""


GAPS = """
marks AS (SELECT ws, s, e FROM isl UNION ALL SELECT ws, duration, duration FROM v_videos),
gap0 AS (SELECT ws, coalesce(lag(e) OVER (PARTITION BY ws ORDER BY s, e), 0) AS s, s AS e FROM marks),
gap AS (SELECT ws, round(s, 3) AS s, round(e, 3) AS e FROM gap0 WHERE e - s > 3.0)"""

COVERAGE = f"""WITH {REPLAY}, {islands_sql("latest", "isl")}, {islands_sql("(SELECT ws, s, e FROM latest WHERE status <> 'hypothesized')", "visl")}, {GAPS},
counts AS (SELECT ws, count(*) AS claims, count(*) FILTER (status = 'hypothesized') AS hypothesized, count(*) FILTER (status = 'verified') AS verified,
  count(*) FILTER (status = 'corrected') AS corrected, round(avg(confidence), 4) AS mean_confidence FROM latest GROUP BY ws),
cov AS (SELECT ws, sum(e - s) AS n FROM isl GROUP BY ws), ver AS (SELECT ws, sum(e - s) AS n FROM visl GROUP BY ws), g AS (SELECT ws, count(*) AS n FROM gap GROUP BY ws),
status AS (SELECT v.ws, coalesce(claims, 0) AS claims, coalesce(hypothesized, 0) AS hypothesized, coalesce(verified, 0) AS verified, coalesce(corrected, 0) AS corrected,
  round(coalesce(cov.n, 0) / duration, 4) AS covered_ratio, round(coalesce(ver.n, 0) / duration, 4) AS verified_ratio, mean_confidence, coalesce(g.n, 0) AS gaps
  FROM v_videos v LEFT JOIN counts USING (ws) LEFT JOIN cov USING (ws) LEFT JOIN ver USING (ws) LEFT JOIN g USING (ws))
"""
NAMES = "ws, line_no, cp_id, status, s, e, confidence"


def claims(v):
    """The ledger replayed once; audits read the table of its latest claims."""
    return saved(ledger.latest(v("v_cp_log")), "claims")


@book.add(COVERAGE + """SELECT *, round(0.4 * covered_ratio + 0.4 * verified_ratio + 0.2 * least(coalesce(mean_confidence, 0), 1), 3) AS score,
  CASE WHEN gaps > 0 OR covered_ratio < 0.999 THEN 'cover_gaps' WHEN verified_ratio < 0.6 THEN 'verify_more' ELSE 'converged' END AS advice FROM status""")
def coverage_status(v):
    """Ledger to readiness: replay, islands, gaps, ratios, advice."""
    return evidence.readiness(evidence.coverage_status(claims(v), saved(v("v_videos"), "videos")))


@book.add("""SELECT ws, line_no, cp_id, CASE WHEN status NOT IN ('hypothesized', 'verified', 'corrected') THEN 'status' WHEN NOT (s >= 0 AND s < e) THEN 'order' WHEN e > duration THEN 'duration' END AS reason,
  s, e FROM (SELECT * EXCLUDE (e), CASE WHEN e > duration AND e - duration <= least(3, greatest(0.05, 0.005 * duration)) THEN duration ELSE e END AS e FROM v_cp_log)""")
def validate_claims(v):
    return ledger.validated(v("v_cp_log")).select("ws", "line_no", "cp_id", "reason", "s", "e")


@book.add(f"WITH {REPLAY} SELECT {NAMES}, first_line FROM latest")
def latest_claims(v):
    return claims(v).select(*NAMES.split(", "), "first_line")


@book.add(f"WITH {REPLAY} SELECT {NAMES}, row_number() OVER (PARTITION BY ws, cp_id ORDER BY line_no) AS revision FROM acc")
def claim_history(v):
    return ledger.history(v("v_cp_log")).select(*NAMES.split(", "), "revision")


@book.add(f"""WITH {REPLAY}, h AS (SELECT *, sum(CASE WHEN has_ve > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ws, cp_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS k FROM acc)
SELECT ws, cp_id, line_no, max(CASE WHEN has_ve > 0 THEN (CASE WHEN has_ve = 2 THEN concat('e', cast(event_id AS varchar)) END) END) OVER (PARTITION BY ws, cp_id, k) AS evidence FROM h""")
def inherited_evidence(v):
    """A line without the field keeps what the claim had; a field given as empty (here null) clears it."""
    lines = ledger.accepted(v("v_cp_log")).withColumns({"present": F.col("has_ve") > 0, "evidence": F.when(F.col("has_ve") == 2, F.concat(F.lit("e"), F.col("event_id").cast("string")))})
    return ledger.inherit(lines, "present", "evidence").select("ws", "cp_id", "line_no", "evidence")


@book.add(f"WITH {REPLAY}, {islands_sql('latest', 'isl')} SELECT ws, s, e FROM isl")
def merged_spans(v):
    return spans.merge_spans(claims(v))


@book.add(f"WITH {REPLAY}, {islands_sql('latest', 'isl')}, {GAPS} SELECT ws, s, e FROM gap")
def coverage_gaps(v):
    return spans.coverage_gaps(claims(v), v("v_videos"))


#: Claims point at segments of their video: ids k and k + 1, some of a text kind that no segment has.
REFS = """refs AS (SELECT ws, cp_id, 0 AS ref, CASE WHEN event_id % 9 = 0 THEN 'string' ELSE 'number' END AS id_kind, cast(floor(s / 6) AS bigint) AS id_key FROM latest WHERE event_id % 7 <> 0
  UNION ALL SELECT ws, cp_id, 1, 'number', cast(floor(s / 6) AS bigint) + 1 FROM latest WHERE event_id % 7 <> 0 AND event_id % 3 = 0),
segs AS (SELECT ws, 'number' AS id_kind, idx AS id_key, 6e0 * idx AS s, 6e0 * idx + 5.5e0 AS e FROM v_loud WHERE db IS NOT NULL)"""
IMAGES = """imgrefs AS (SELECT ws, cp_id, concat('frames/', cast(cast(s AS bigint) // 4 AS varchar), '.jpg') AS path FROM latest WHERE event_id % 5 <> 0),
imgs AS (SELECT ws, concat('frames/', cast(idx AS varchar), '.jpg') AS path, CASE WHEN idx % 13 <> 0 THEN idx % 6 <> 0 END AS tracked, CASE WHEN idx % 10 = 3 THEN 'filmstrip' ELSE 'frame' END AS kind, idx % 11 <> 0 AS decodable,
  CASE WHEN idx % 7 = 2 THEN [4e0 * idx + (idx % 5), 4e0 * idx + 9] ELSE [] END AS stamps, CASE WHEN idx % 4 = 0 THEN NULL ELSE 4e0 * idx + (idx % 5) END AS t,
  CASE WHEN idx % 8 = 4 THEN 4e0 * idx + (idx % 3) END AS span_s, CASE WHEN idx % 8 = 4 THEN 4e0 * idx + (idx % 3) + 2 END AS span_e FROM v_loud)"""
LEVELS = f"""{REFS}, {IMAGES},
tr AS (SELECT ws, cp_id, bool_and(ok) AS ok FROM (SELECT l.ws, l.cp_id, r.ref, bool_or(coalesce(greatest(l.s, g.s) < least(l.e, g.e), false)) AS ok FROM latest l JOIN refs r USING (ws, cp_id) LEFT JOIN segs g ON g.ws = r.ws AND g.id_kind = r.id_kind AND g.id_key = r.id_key GROUP BY ALL) GROUP BY ws, cp_id),
vis AS (SELECT ws, cp_id, path, unnest(CASE WHEN len(x) = 0 THEN [NULL] ELSE x END) AS issue FROM (SELECT l.ws, l.cp_id, r.path, CASE WHEN i.path IS NULL OR NOT i.decodable THEN ['undecodable'] WHEN i.tracked IS NULL THEN ['untracked'] ELSE list_filter([CASE WHEN NOT i.tracked THEN 'untracked' END, CASE WHEN i.kind = 'filmstrip' THEN 'filmstrip' END,
  CASE WHEN len(i.stamps) > 0 THEN CASE WHEN len([x FOR x IN i.stamps IF l.s <= x AND x < l.e]) = 0 THEN 'outside_span' END WHEN i.t IS NOT NULL THEN CASE WHEN NOT (l.s <= i.t AND i.t < l.e) THEN 'outside_span' END
    WHEN i.span_s IS NOT NULL THEN CASE WHEN NOT greatest(l.s, i.span_s) < least(l.e, i.span_e) THEN 'outside_span' END ELSE 'time_unavailable' END], lambda x: x IS NOT NULL) END AS x
  FROM latest l JOIN imgrefs r USING (ws, cp_id) LEFT JOIN imgs i ON i.ws = r.ws AND i.path = r.path)),
vs AS (SELECT ws, cp_id, bool_or(issue IS NULL) AS ok FROM vis GROUP BY ws, cp_id),
levels AS (SELECT l.ws, l.cp_id, l.status, l.has_ve, l.event_id, coalesce(tr.ok, false) AS transcript_support, coalesce(vs.ok, false) AS visual_support FROM latest l LEFT JOIN tr USING (ws, cp_id) LEFT JOIN vs USING (ws, cp_id)),
lev AS (SELECT *, CASE WHEN transcript_support AND visual_support THEN 'cross_modal' WHEN visual_support THEN 'visual_only' WHEN transcript_support THEN 'transcript_only' ELSE 'unsupported' END AS level FROM levels),
settled AS (SELECT * FROM lev WHERE status <> 'hypothesized'),
issues AS (SELECT ws, cp_id, 'missing_support' AS code, NULL AS artifact FROM settled WHERE level = 'unsupported'
  UNION ALL SELECT vis.ws, vis.cp_id, concat('visual_', issue), path FROM vis JOIN settled s ON s.ws = vis.ws AND s.cp_id = vis.cp_id WHERE issue IS NOT NULL
  UNION ALL SELECT ws, cp_id, 'correction_note_missing', NULL FROM settled WHERE status = 'corrected' AND event_id % 3 <> 0
  UNION ALL SELECT ws, cp_id, 'legacy_unstructured', NULL FROM settled WHERE has_ve = 1 AND level = 'unsupported')"""


def grounded(v):
    c = claims(v)
    base = c.filter(F.col("event_id") % 7 != 0)
    key = F.floor(F.col("s") / 6).cast("long")
    one = base.select("ws", "cp_id", F.lit(0).alias("ref"), F.when(F.col("event_id") % 9 == 0, "string").otherwise("number").alias("id_kind"), key.alias("id_key"))
    two = base.filter(F.col("event_id") % 3 == 0).select("ws", "cp_id", F.lit(1).alias("ref"), F.lit("number").alias("id_kind"), (key + 1).alias("id_key"))
    loud = v("v_loud")
    segs = loud.filter("db IS NOT NULL").select("ws", F.lit("number").alias("id_kind"), F.col("idx").cast("long").alias("id_key"), (F.col("idx") * 6.0).alias("s"), (F.col("idx") * 6.0 + 5.5).alias("e"))
    refs = c.filter(F.col("event_id") % 5 != 0).select("ws", "cp_id", F.concat(F.lit("frames/"), F.floor(F.col("s") / 4).cast("string"), F.lit(".jpg")).alias("path"))
    idx = F.col("idx")
    begin = F.when(idx % 8 == 4, idx * 4.0 + idx % 3)
    images = loud.select(
        "ws", F.concat(F.lit("frames/"), idx.cast("string"), F.lit(".jpg")).alias("path"), F.when(idx % 13 != 0, idx % 6 != 0).alias("tracked"), F.when(idx % 10 == 3, "filmstrip").otherwise("frame").alias("kind"),
        (idx % 11 != 0).alias("decodable"), F.when(idx % 7 == 2, F.array(idx * 4.0 + idx % 5, idx * 4.0 + 9)).otherwise(F.array().cast("array<double>")).alias("timestamps"), F.when(idx % 4 != 0, idx * 4.0 + idx % 5).alias("t"),
        begin.alias("span_s"), (begin + 2).alias("span_e"),
    )
    visual = evidence.visual_evidence(c, refs, images)
    visual = saved(visual, "visual")
    levels = evidence.support_levels(c.withColumns({"note": F.when(F.col("event_id") % 3 == 0, "why").when(F.col("event_id") % 3 == 1, " "), "legacy": F.col("has_ve") == 1}), evidence.transcript_support(c, one.unionByName(two), segs), visual)
    return levels, visual


@book.add(f"WITH {REPLAY}, {LEVELS} SELECT ws, cp_id, status, transcript_support, visual_support, level FROM lev")
def support_levels(v):
    return grounded(v)[0].select("ws", "cp_id", "status", "transcript_support", "visual_support", "level")


@book.add(f"WITH {REPLAY}, {LEVELS} SELECT ws, cp_id, path, issue FROM vis")
def visual_issues(v):
    return grounded(v)[1]


@book.add(f"WITH {REPLAY}, {LEVELS} SELECT ws, cp_id, code, artifact FROM issues")
def verification_audit(v):
    return evidence.verification_issues(*grounded(v))


SUPPORT = COVERAGE + f""", {LEVELS}, {islands_sql("(SELECT l.ws, l.s, l.e FROM settled x JOIN latest l ON l.ws = x.ws AND l.cp_id = x.cp_id WHERE x.level <> 'unsupported')", "spi")},
sl AS (SELECT ws, sum(e - s) AS n FROM spi GROUP BY ws), sn AS (SELECT ws, count(*) AS settled, count(*) FILTER (level <> 'unsupported') AS supported FROM settled GROUP BY ws),
su AS (SELECT s.*, coalesce(sn.settled, 0) AS settled, coalesce(sn.supported, 0) AS supported, round(coalesce(sl.n, 0) / duration, 4) AS supported_ratio FROM status s JOIN v_videos v ON v.ws = s.ws LEFT JOIN sn ON sn.ws = s.ws LEFT JOIN sl ON sl.ws = s.ws),
rd AS (SELECT *, round(0.4 * covered_ratio + 0.4 * supported_ratio + 0.2 * least(coalesce(mean_confidence, 0), 1), 3) AS score,
  CASE WHEN gaps > 0 OR covered_ratio < 0.999 THEN 'cover_gaps' WHEN supported_ratio < 0.6 OR supported < settled THEN 'verify_more' ELSE 'converged' END AS advice FROM su)"""


def ready(v, levels):
    videos = saved(v("v_videos"), "videos")
    return evidence.readiness(evidence.coverage_status(levels, videos), evidence.support(levels, videos))


@book.add(SUPPORT + " SELECT * FROM rd")
def readiness_by_support(v):
    """Readiness where the supported part of a video counts, not the settled one."""
    return ready(v, saved(grounded(v)[0], "levels"))


@book.add(SUPPORT + " SELECT 'advice' AS kind, advice AS name, count(*) AS n FROM rd GROUP BY advice UNION ALL SELECT 'level', level, count(*) FROM settled GROUP BY level")
def corpus_counts(v):
    levels = saved(grounded(v)[0], "levels")
    return evidence.corpus_counts(ready(v, levels), levels)


@book.add(f"WITH {REPLAY}, {LEVELS} SELECT ws, code, count(*) AS n FROM issues GROUP BY ROLLUP (ws, code)")
def corpus_audit(v):
    return evidence.corpus_totals(evidence.verification_issues(*grounded(v)))


LOUDEST = """f AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY db, idx) AS rk, count(*) OVER (PARTITION BY ws) AS n FROM v_loud WHERE db IS NOT NULL),
lim AS (SELECT ws, median(db) AS med, greatest(max(CASE WHEN rk = floor(0.75 * (n - 1)) + 1 THEN db END), median(db) + 3) AS lim FROM f GROUP BY ws HAVING max(n) >= 4),
hot AS (SELECT f.ws, idx, db, med, CASE WHEN idx - lag(idx) OVER (PARTITION BY f.ws ORDER BY idx) > 2 THEN 1 ELSE 0 END AS nw FROM f JOIN lim l ON l.ws = f.ws WHERE db >= lim),
run AS (SELECT ws, min(idx) AS a, max(idx) AS b, round(sum(db - med), 1) AS score, round(max(db), 1) AS peak_db FROM (SELECT *, sum(nw) OVER (PARTITION BY ws ORDER BY idx) AS r FROM hot) GROUP BY ws, r),
sp AS (SELECT r.ws, greatest(a - 1, 0) * 0.5e0 AS s, least(b + 1, m) * 0.5e0 + 0.5e0 AS e, score, peak_db FROM run r JOIN (SELECT ws, max(idx) AS m FROM v_loud GROUP BY ws) x ON x.ws = r.ws),
lsp AS (SELECT ws, s, e, score, peak_db FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY score DESC, s) AS p FROM sp) WHERE p <= 5)"""


@book.add(f"WITH {LOUDEST} SELECT * FROM lsp")
def loud_spans(v):
    return signals.loud_spans(v("v_loud"))


HITS = """hits AS (SELECT ws, idx, t, score FROM (SELECT *, avg(score) OVER (PARTITION BY ws ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS b FROM v_scene) WHERE score >= 0.3 OR (score >= 0.04 AND b IS NOT NULL AND score >= 3 * b))"""


@book.add(f"WITH {HITS} SELECT * FROM hits")
def scene_changes(v):
    return signals.scene_hits(v("v_scene"), 0.25)


@book.add("""SELECT ws, idx, t, score FROM (SELECT *, avg(score) OVER (PARTITION BY ws ORDER BY idx ROWS BETWEEN (CASE ws % 3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 3 END) PRECEDING AND 1 PRECEDING) AS b FROM (SELECT ws, idx, t * (1 + ws % 3) AS t, score FROM v_scene)) WHERE score >= 0.3 OR (score >= 0.04 AND b IS NOT NULL AND score >= 3 * b)""")
def scene_changes_by_rate(v):
    """Videos of three frame rates, in pieces of 16 frames."""
    return signals.scene_hits(v("v_scene").withColumn("t", F.col("t") * (1 + F.col("ws") % 3)), chunk=16)


SUPPRESSED = f"""{HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY t) AS k FROM hits),
fold AS (SELECT ws, k, t AS kt, score AS ks, 1 AS grp FROM o WHERE k = 1
  UNION ALL SELECT o.ws, o.k, CASE WHEN o.t - f.kt < 1.0 AND o.score <= f.ks THEN f.kt ELSE o.t END, CASE WHEN o.t - f.kt < 1.0 THEN greatest(o.score, f.ks) ELSE o.score END, f.grp + CASE WHEN o.t - f.kt < 1.0 THEN 0 ELSE 1 END
  FROM fold f JOIN o ON o.ws = f.ws AND o.k = f.k + 1),
sup AS (SELECT ws, kt AS t, ks AS score FROM (SELECT *, row_number() OVER (PARTITION BY ws, grp ORDER BY k DESC) AS r FROM fold) WHERE r = 1)"""


@book.add(f"WITH RECURSIVE {SUPPRESSED} SELECT * FROM sup")
def scene_suppress(v):
    return signals.suppress_scenes(signals.scene_hits(v("v_scene"), 0.25))


@book.add(f"""WITH {HITS} SELECT h.ws, h.t, h.score, coalesce(max(distance), 0) AS color, coalesce(max(distance), 0) >= 0.5 AS color_confirmed FROM hits h LEFT JOIN v_color c ON c.ws = h.ws AND abs(c.t - h.t) <= 0.75 GROUP BY h.ws, h.t, h.score""")
def color_confirm(v):
    return signals.confirm_by_color(signals.scene_hits(v("v_scene"), 0.25).select("ws", "t", "score"), v("v_color"))


@book.add("""WITH o AS (SELECT *, CASE WHEN lag(label) OVER w = label AND t - round(lag(t) OVER w + 1.5, 2) <= 2.0 THEN 0 ELSE 1 END AS nw FROM v_hits WINDOW w AS (PARTITION BY ws ORDER BY t, label, conf)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY ws ORDER BY t, label, conf ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT ws, label, min(t) AS s, round(max(t) + 1.5, 2) AS e, max(conf) AS peak_conf FROM r GROUP BY ws, run, label""")
def audio_event_spans(v):
    return signals.audio_events(v("v_hits"))


@book.add("""SELECT ws, floor(t / 6) * 6 AS t, string_agg(concat('to ', label), ' ' ORDER BY t, label, conf) AS text FROM v_hits WHERE conf >= 0.3 GROUP BY ALL""")
def screen_samples(v):
    """Hits of six seconds as the lines of one frame: the earlier, the higher."""
    line = F.concat(F.lit(" to\t "), "label", F.lit("\n"))
    lines = v("v_hits").select("ws", (F.floor(F.col("t") / 6) * 6.0).alias("t"), F.struct("label", "conf").alias("k"), line.alias("text"), "conf", (-F.col("t")).alias("y"))
    return signals.screen_samples(lines)


@book.add("""WITH x AS (SELECT ws, t, label AS text FROM (SELECT ws, idx * 2e0 AS t, CASE WHEN idx % 5 = 0 THEN ' ' ELSE concat('Sign ', cast((idx // 4) % 3 AS varchar)) END AS label FROM v_loud) WHERE trim(label) <> ''),
n AS (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY ws ORDER BY t) = text THEN 0 ELSE 1 END AS nw FROM x), r AS (SELECT *, sum(nw) OVER (PARTITION BY ws ORDER BY t) AS run FROM n)
SELECT ws, min(t) AS s, max(least(t + 2, 600)) AS e, text FROM r GROUP BY ws, run, text""")
def screen_text(v):
    idx = F.col("idx")
    text = F.when(idx % 5 == 0, " ").otherwise(F.concat(F.lit("Sign  "), (F.floor(idx / 4) % 3).cast("string")))
    return signals.screen_text_spans(v("v_loud").select("ws", (idx * 2.0).alias("t"), text.alias("text"), F.lit(600.0).alias("duration")), 2.0)


@book.add("""WITH b AS (SELECT ws, idx, t, roi FROM (SELECT *, row_number() OVER (PARTITION BY ws, idx ORDER BY motion DESC, roi_order) AS r FROM v_motion) WHERE r = 1),
n AS (SELECT *, CASE WHEN lag(roi) OVER (PARTITION BY ws ORDER BY idx) = roi THEN 0 ELSE 1 END AS nw FROM b), r AS (SELECT *, sum(nw) OVER (PARTITION BY ws ORDER BY idx) AS run FROM n),
a AS (SELECT ws, run, roi, min(t) AS s, max(t) + 0.25 AS e FROM r GROUP BY ws, run, roi),
k AS (SELECT *, last_value(CASE WHEN run = 1 OR e - s >= 1 THEN roi END IGNORE NULLS) OVER (PARTITION BY ws ORDER BY run) AS kroi FROM a),
m AS (SELECT *, CASE WHEN lag(kroi) OVER (PARTITION BY ws ORDER BY s) = kroi THEN 0 ELSE 1 END AS nw FROM k), z AS (SELECT *, sum(nw) OVER (PARTITION BY ws ORDER BY s) AS g FROM m)
SELECT ws, min(s) AS s, max(e) AS e, kroi AS roi FROM z GROUP BY ws, g, kroi""")
def active_regions(v):
    return signals.active_regions(v("v_motion"), 0.25)


@book.add("""WITH h AS (SELECT label AS ws, vec_id AS idx, [abs(x::double) for x in embedding] AS a FROM embeddings), g AS (SELECT ws, idx, [x / list_sum(a) for x in a] AS hist FROM h),
l AS (SELECT *, lag(hist) OVER (PARTITION BY ws ORDER BY idx) AS before FROM g)
SELECT ws, idx, round(sqrt(greatest(0, 1 - list_sum([sqrt(p[1] * p[2]) for p in list_zip(before, hist)]))), 6) AS distance FROM l WHERE before IS NOT NULL""")
def color_distance(v):
    absolute = F.transform(F.col("embedding").cast("array<double>"), F.abs)
    total = F.aggregate(absolute, F.lit(0.0), lambda a, x: a + x)
    hist = v("embeddings").select(F.col("label").alias("ws"), F.col("vec_id").alias("idx"), absolute.alias("a"), total.alias("n")).select("ws", "idx", F.transform("a", lambda x: x / F.col("n")).alias("hist"))
    return signals.color_distance(hist).withColumn("distance", F.round("distance", 6))


@book.add(f"""WITH {REPLAY}, {LEVELS} SELECT l.ws, l.cp_id, lev.level, CASE WHEN l.event_id % 5 <> 0 AND l.event_id % 7 <> 0 THEN 'cross_modal' WHEN l.event_id % 5 <> 0 THEN 'visual_only' WHEN l.event_id % 7 <> 0 THEN 'transcript_only' ELSE 'unsupported' END AS declared
FROM latest l JOIN lev ON lev.ws = l.ws AND lev.cp_id = l.cp_id""")
def verification_levels(v):
    """What claims declare by their references beside what holds."""
    levels = saved(grounded(v)[0], "levels")
    has = lambda k: levels.withColumn("cited", F.when(F.col("event_id") % k != 0, True)).filter("cited")
    return evidence.declared_levels(levels, has(7), has(5)).join(levels.select("ws", "cp_id", "level"), ["ws", "cp_id"])


@book.add(f"""WITH {REPLAY}, {LEVELS} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY cp_id, code, artifact NULLS FIRST) AS place, count(*) OVER (PARTITION BY ws) AS total FROM issues) WHERE place <= 3""")
def corpus_details(v):
    """The first three issues of each video."""
    return evidence.details(saved(evidence.verification_issues(*grounded(v)), "issues"), ["ws"], ["cp_id", "code", "artifact"], 3)


@book.add(SUPPORT + """, im AS (SELECT ws, string_agg(concat(code, ':', cast(n AS varchar)), ',' ORDER BY code) AS issues FROM (SELECT ws, code, count(*) AS n FROM issues GROUP BY ALL) GROUP BY ws)
SELECT ws, advice, verified_ratio, supported_ratio, settled, supported, coalesce(im.issues, '') AS issues FROM rd LEFT JOIN im USING (ws)""")
def corpus_rows(v):
    levels, visual = grounded(v)
    levels = saved(levels, "levels")
    return evidence.corpus_rows(ready(v, levels), evidence.verification_issues(levels, visual))
