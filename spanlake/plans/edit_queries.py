"""Queries of edits, images, keyframes, storage and terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import times as tm
from ..operators import edits, images, signals, storage, terms
from ..sources import readers
from ..sources.tables import saved
from .base import Book
from .timeline_queries import HITS, LOUDEST, REPLAY, SUPPRESSED, claims, islands_sql

book = Book()

EDGES = "eg AS (SELECT DISTINCT ws, t FROM (SELECT ws, round(s, 3) AS t FROM v_cuts UNION ALL SELECT ws, round(e, 3) FROM v_cuts))"


@book.add(f"WITH {EDGES} SELECT * FROM eg")
def cut_edges(v):
    return edits.cut_edges(v("v_cuts"))


#: Turns of conversations as cuts among their own words: edges a little after the start of each segment.
ALIGN = """eg AS (SELECT DISTINCT ws, s + 0.125e0 * (pos % 4) AS t FROM v_seg),
al AS (SELECT eg.ws, eg.t, (SELECT min_by(w.word, ROW(w.s, w.e, w.word)) FROM v_words w WHERE w.ws = eg.ws AND w.s < eg.t AND eg.t < w.e) AS in_word,
  (SELECT max(w.e) FROM v_words w WHERE w.ws = eg.ws AND w.e <= eg.t) AS prev_end, (SELECT min(w.s) FROM v_words w WHERE w.ws = eg.ws AND w.s >= eg.t) AS next_start FROM eg),
ag AS (SELECT *, CASE WHEN in_word IS NULL THEN round(next_start - prev_end, 6) END AS gap, CASE WHEN in_word IS NULL THEN round(t - prev_end, 6) END AS tail_gap FROM al)"""


def aligned(v):
    edges = v("v_seg").select("ws", (F.col("s") + 0.125 * (F.col("pos") % 4)).alias("t")).distinct()
    return edits.word_alignment(edges, v("v_words"))


@book.add(f"WITH {ALIGN} SELECT ws, t, in_word, prev_end, next_start, gap, tail_gap FROM ag")
def word_alignment(v):
    return aligned(v).select("ws", "t", "in_word", "prev_end", "next_start", "gap", "tail_gap")


LEVEL = "round(greatest(-99, 10 * log10(avg(pow(10, db / 10)))), 2)"


@book.add(f"""WITH {ALIGN}, b AS (SELECT ag.ws, ag.t, {LEVEL} AS d FROM ag JOIN v_loud l ON l.ws = ag.ws AND l.db IS NOT NULL AND l.t >= ag.t - 0.4 AND l.t < ag.t GROUP BY ALL),
a AS (SELECT ag.ws, ag.t, {LEVEL} AS d FROM ag JOIN v_loud l ON l.ws = ag.ws AND l.db IS NOT NULL AND l.t <= ag.t + 0.4 AND l.t >= ag.t GROUP BY ALL)
SELECT ag.ws, ag.t, round(abs(b.d - a.d), 2) AS step_db, concat_ws(',', CASE WHEN round(abs(b.d - a.d), 2) > 12 THEN 'loud_step' END, CASE WHEN tail_gap < 0.12 AND gap >= 0.3 THEN 'tight_tail' END, CASE WHEN trim(in_word) <> '' THEN 'word_interior' END) AS flags
FROM ag LEFT JOIN b USING (ws, t) LEFT JOIN a USING (ws, t)""")
def boundary_flags(v):
    return edits.boundary_flags(aligned(v), v("v_loud")).select("ws", "t", "step_db", F.array_join("flags", ",").alias("flags"))


@book.add(f"""WITH p AS (SELECT * FROM (SELECT ws, seq_id, ord, round(e, 3) AS from_t, lead(round(s, 3)) OVER (PARTITION BY ws, seq_id ORDER BY ord) AS to_t FROM v_cuts) WHERE to_t IS NOT NULL),
o AS (SELECT p.ws, seq_id, ord, {LEVEL} AS d FROM p JOIN v_loud l ON l.ws = p.ws AND db IS NOT NULL AND l.t >= from_t - 0.4 AND l.t < from_t GROUP BY ALL),
i AS (SELECT p.ws, seq_id, ord, {LEVEL} AS d FROM p JOIN v_loud l ON l.ws = p.ws AND db IS NOT NULL AND l.t >= to_t AND l.t <= to_t + 0.4 GROUP BY ALL)
SELECT p.ws, p.seq_id, p.ord, from_t, to_t, round(abs(o.d - i.d), 2) AS step_db, (p.ord * 37 % 64) / 64e0 AS ssim,
  concat_ws(',', CASE WHEN (p.ord * 37 % 64) / 64e0 > 0.5 AND to_t - from_t > 0.04 THEN 'jump_cut_risk' END, CASE WHEN round(abs(o.d - i.d), 2) > 2 THEN 'loud_join' END) AS flags
FROM p LEFT JOIN o USING (ws, seq_id, ord) LEFT JOIN i USING (ws, seq_id, ord)""")
def cut_joins(v):
    """Steps over 2 dB and likeness over 0.5, which these series reach."""
    ssim = v("v_cuts").select("ws", "seq_id", "ord", (F.col("ord") * 37 % 64 / 64.0).alias("ssim"))
    return edits.cut_joins(v("v_cuts"), v("v_loud"), ssim, step=2.0, alike=0.5).withColumn("flags", F.array_join("flags", ","))


#: Each cut cites its own claim and the one after it.
REFS = """rf AS (SELECT ws, seq_id, ord, cp_id FROM v_cuts UNION SELECT ws, seq_id, ord, concat('cp-', lpad(cast((event_id + 1) % 20 AS varchar), 3, '0')) FROM v_cuts)"""


def refs(v):
    cuts = v("v_cuts")
    after = F.concat(F.lit("cp-"), F.lpad(((F.col("event_id") + 1) % 20).cast("string"), 3, "0"))
    return cuts.select("ws", "seq_id", "ord", "cp_id").union(cuts.select("ws", "seq_id", "ord", after)).distinct()


@book.add(f"""WITH {REPLAY}, {REFS}, h AS (SELECT rf.ws, rf.seq_id, rf.ord, c.s, c.e, l.s AS cs, l.e AS ce FROM rf JOIN v_cuts c ON c.ws = rf.ws AND c.seq_id = rf.seq_id AND c.ord = rf.ord LEFT JOIN latest l ON l.ws = rf.ws AND l.cp_id = rf.cp_id),
ins AS (SELECT ws, seq_id, ord, greatest(cs, s) AS s, least(ce, e) AS e FROM h WHERE cs IS NOT NULL), {islands_sql("ins", "isl", "ws, seq_id, ord")},
mk AS (SELECT ws, seq_id, ord, s, e FROM isl UNION ALL SELECT ws, seq_id, ord, e, e FROM v_cuts),
gp AS (SELECT m.ws, m.seq_id, m.ord, coalesce(lag(m.e) OVER (PARTITION BY m.ws, m.seq_id, m.ord ORDER BY m.s, m.e), c.s) AS s, m.s AS e, c.s AS lo, c.e AS hi FROM mk m JOIN v_cuts c ON c.ws = m.ws AND c.seq_id = m.seq_id AND c.ord = m.ord)
SELECT ws, seq_id, ord, s, e, 'uncovered' AS reason FROM gp WHERE e - s > 1e-9 AND NOT ((s = lo OR e = hi) AND e - s <= least(2, 0.1 * (hi - lo)))
UNION ALL SELECT DISTINCT ws, seq_id, ord, s, e, 'claim_outside' FROM h WHERE cs IS NULL OR NOT greatest(s, cs) < least(e, ce)""")
def cut_coverage(v):
    return edits.cut_coverage(v("v_cuts"), refs(v), claims(v))


@book.add(f"""WITH {REPLAY}, {REFS}, want AS (SELECT DISTINCT ws, seq_id, cp_id FROM rf), pin AS (SELECT DISTINCT ws, seq_id, cp_id, CASE WHEN cp_id IN ('cp-003', 'cp-011') THEN 0 ELSE 1 END AS same FROM (SELECT ws, seq_id, cp_id FROM rf WHERE cp_id <> 'cp-007' UNION SELECT ws, seq_id, 'cp-019' FROM rf)),
b AS (SELECT coalesce(w.ws, p.ws) AS ws, coalesce(w.seq_id, p.seq_id) AS seq_id, coalesce(w.cp_id, p.cp_id) AS cp_id, w.cp_id AS wc, p.cp_id AS pc, p.same FROM want w FULL JOIN pin p ON w.ws = p.ws AND w.seq_id = p.seq_id AND w.cp_id = p.cp_id)
SELECT * FROM (SELECT b.ws, b.seq_id, b.cp_id, CASE WHEN pc IS NULL THEN 'missing' WHEN wc IS NULL THEN 'extra' WHEN l.cp_id IS NULL OR same = 0 THEN 'drifted' END AS state FROM b LEFT JOIN latest l ON l.ws = b.ws AND l.cp_id = b.cp_id) WHERE state IS NOT NULL""")
def pin_check(v):
    """Pins of current hashes, but for two claims pinned to an old one, one never pinned and one pinned without being cited."""
    now = claims(v).select("ws", "cp_id", edits.revision_hash("confidence", "cp_id", "e", "s", "status").alias("revision"))
    cited = refs(v).select("ws", "seq_id", "cp_id").distinct()
    pinned = cited.filter("cp_id <> 'cp-007'").union(cited.select("ws", "seq_id", F.lit("cp-019")).distinct()).distinct().join(now, ["ws", "cp_id"], "left")
    old = F.when(F.col("cp_id").isin("cp-003", "cp-011"), "old").otherwise(F.coalesce("revision", F.lit("gone")))
    return edits.pin_states(cited, pinned.select("ws", "seq_id", "cp_id", old.alias("revision")), now)


def clock(frames: str) -> str:
    return f"concat_ws(':', lpad(cast({frames} // 30 // 3600 AS varchar), 2, '0'), lpad(cast({frames} // 30 // 60 % 60 AS varchar), 2, '0'), lpad(cast({frames} // 30 % 60 AS varchar), 2, '0'), lpad(cast({frames} % 30 AS varchar), 2, '0'))"


@book.add(f"""WITH r AS (SELECT *, sum(e - s) OVER (PARTITION BY ws, seq_id ORDER BY ord) AS z FROM v_cuts),
f AS (SELECT ws, seq_id, ord, cast(round_even(s * 30000 / 1001, 0) AS bigint) AS a, cast(round_even(e * 30000 / 1001, 0) AS bigint) AS b, cast(round_even((z - e + s) * 30000 / 1001, 0) AS bigint) AS c, cast(round_even(z * 30000 / 1001, 0) AS bigint) AS d FROM r)
SELECT ws, seq_id, row_number() OVER (PARTITION BY ws, seq_id ORDER BY ord) AS event, {clock("a")} AS src_in, {clock("b")} AS src_out, {clock("c")} AS rec_in, {clock("d")} AS rec_out FROM f""")
def edl_events(v):
    return edits.edl_events(v("v_cuts"), 30000, 1001)


@book.add("SELECT ws, seq_id, count(*) AS events, concat(count(*), ' events, at most 5 fit: split by claims or write markers') AS reason FROM v_cuts GROUP BY ALL HAVING count(*) >= 6")
def edl_rejects(v):
    """Of lists of 5 events at most, since these sequences have 6 at most."""
    return edits.edl_rejects(v("v_cuts"), 5)


SRT = "concat(lpad(cast({0} // 3600000 AS varchar), 2, '0'), ':', lpad(cast({0} // 60000 % 60 AS varchar), 2, '0'), ':', lpad(cast({0} // 1000 % 60 AS varchar), 2, '0'), ',', lpad(cast({0} % 1000 AS varchar), 3, '0'))"


@book.add(f"""WITH c AS (SELECT ws, 'seq-001' AS seq_id, pos AS ord, s + 1 AS s, e + 2 AS e FROM v_seg), p AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY ws ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rec FROM c),
x AS (SELECT p.ws, seq_id, ord, g.s AS rs, g.text, rec + greatest(p.s, g.s) - p.s AS a, rec + least(p.e, g.e) - p.s AS b FROM p JOIN v_seg g ON g.ws = p.ws AND greatest(p.s, g.s) < least(p.e, g.e))
SELECT ws, seq_id, row_number() OVER (PARTITION BY ws, seq_id ORDER BY a, ord, rs, text) AS cue, {SRT.format("cast(round(a * 1000) AS bigint)")} AS start, {SRT.format("cast(round(b * 1000) AS bigint)")} AS "end", text FROM x""")
def srt_cues(v):
    cuts = v("v_seg").select("ws", F.lit("seq-001").alias("seq_id"), F.col("pos").alias("ord"), (F.col("s") + 1).alias("s"), (F.col("e") + 2).alias("e"))
    return edits.srt_cues(cuts, v("v_seg"))


@book.add(f"""WITH {REPLAY}, x AS (SELECT ws, cp_id, s, e, coalesce(max(e) OVER (PARTITION BY ws ORDER BY s, cp_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM latest), {islands_sql("latest", "isl")},
m AS (SELECT ws, s, e FROM isl UNION ALL SELECT ws, duration, duration FROM v_videos), g AS (SELECT ws, coalesce(lag(e) OVER (PARTITION BY ws ORDER BY s, e), 0) AS s, s AS e FROM m)
SELECT ws, greatest(s, cur) AS s, e, cp_id FROM x WHERE e > greatest(s, cur) UNION ALL SELECT ws, s, e, NULL FROM g WHERE e > s""")
def timeline_strip(v):
    return edits.timeline_strip(claims(v), v("v_videos"))


@book.add("SELECT ws, seq_id, count(*) AS lines, sha256(string_agg(concat(seq_id, ' ', cast(ord AS varchar), ' ', cp_id), chr(10) ORDER BY ord)) AS receipt FROM v_cuts GROUP BY ws, seq_id")
def receipt(v):
    return edits.receipt(v("v_cuts"), ["ws", "seq_id"], F.concat_ws(" ", "seq_id", F.col("ord").cast("string"), "cp_id"), "ord")


@book.add(f"WITH {islands_sql('v_cuts', 'isl', 'ws, seq_id')} SELECT * FROM (SELECT ws, seq_id, sum(e - s) AS length FROM v_cuts GROUP BY ALL) JOIN (SELECT ws, seq_id, sum(e - s) AS unique_length FROM isl GROUP BY ALL) USING (ws, seq_id)")
def covered_share(v):
    return edits.covered_share(v("v_cuts"))


# images

IMG = """ev AS (SELECT ws, line_no, concat('img-', cast(cast(substr(path, 9, 9) AS bigint) % 40 AS varchar)) AS image_id, path, edge_id, cause_id, CASE WHEN line_no % 6 = 0 THEN 'inventory' ELSE 'capture' END AS source, CASE WHEN line_no % 4 = 1 THEN '' ELSE reason END AS reason, t, nullif(kind, '') AS kind FROM v_image_events),
ex AS (SELECT DISTINCT ws, path FROM v_image_events WHERE line_no % 3 = 0),
cat AS (SELECT ev.ws, image_id, min(ROW(ex.path IS NULL, ev.path)) AS best, bool_or(ex.path IS NOT NULL) AS "exists", bool_or(source <> 'inventory') AS tracked,
  arg_max(t, CASE WHEN t IS NOT NULL THEN line_no END) AS t, arg_max(kind, CASE WHEN kind IS NOT NULL THEN line_no END) AS kind FROM ev LEFT JOIN ex ON ex.ws = ev.ws AND ex.path = ev.path GROUP BY ev.ws, image_id),
pr AS (SELECT ws, image_id, arg_max(reason, line_no) AS reason FROM ev WHERE reason <> '' GROUP BY ws, image_id),
ct AS (SELECT ws, CASE WHEN line_no % 10 = 0 THEN concat('img-', cast(cast(substr(path, 9, 9) AS bigint) % 40 AS varchar)) WHEN line_no % 5 = 0 THEN path ELSE 'elsewhere' END AS cited, cause_id AS cp_id, line_no FROM v_image_events),
bl AS (SELECT ws, image_id, string_agg(cp_id, ',' ORDER BY fl, cp_id) AS cp_ids FROM (SELECT r.ws, c.image_id, r.cp_id, min(r.line_no) AS fl FROM ct r JOIN (SELECT ws, image_id, best[2] AS path FROM cat) c ON c.ws = r.ws AND (c.path = r.cited OR c.image_id = r.cited) GROUP BY ALL) GROUP BY ws, image_id)"""


def events(v):
    image = F.concat(F.lit("img-"), (F.substring("path", 9, 9).cast("long") % 40).cast("string"))
    return v("v_image_events").withColumns({"image_id": image, "source": F.when(F.col("line_no") % 6 == 0, "inventory").otherwise("capture"), "reason": F.when(F.col("line_no") % 4 == 1, "").otherwise(F.col("reason")), "kind": F.nullif("kind", F.lit(""))})


def image_catalog_of(v):
    return saved(images.catalog(events(v), v("v_image_events").filter("line_no % 3 = 0"), ["t", "kind"]), "catalog")


def links_of(v):
    """Every event cites: an image's id, its path, or what is no image."""
    n = F.col("line_no")
    cited = events(v).select("ws", F.when(n % 10 == 0, F.col("image_id")).when(n % 5 == 0, F.col("path")).otherwise("elsewhere").alias("path"), F.col("cause_id").alias("cp_id"), n.alias("first_line"))
    return images.backlinks(cited, image_catalog_of(v))


@book.add(f'WITH {IMG} SELECT ws, image_id, best[2] AS path, "exists", tracked, t, kind FROM cat')
def image_catalog(v):
    return image_catalog_of(v)


@book.add(f"WITH {IMG} SELECT * FROM bl")
def image_backlinks(v):
    return links_of(v).withColumn("cp_ids", F.array_join("cp_ids", ","))


@book.add(f"WITH {IMG} SELECT c.ws, c.image_id, CASE WHEN bl.image_id IS NOT NULL THEN 'interpreted' WHEN pr.reason <> '' THEN 'captured' ELSE 'unsourced' END AS tier FROM cat c LEFT JOIN bl ON bl.ws = c.ws AND bl.image_id = c.image_id LEFT JOIN pr ON pr.ws = c.ws AND pr.image_id = c.image_id")
def image_tiers(v):
    return images.tiers(image_catalog_of(v).join(images.preferred_reason(events(v)), ["ws", "image_id"], "left"), links_of(v))


@book.add(f"""WITH {IMG}, n AS (SELECT ws, image_id, count(DISTINCT edge_id) AS n FROM ev WHERE reason <> '' GROUP BY ws, image_id) SELECT c.ws, count(*) AS images, count(*) FILTER ("exists") AS available, count(*) FILTER (tracked) AS tracked, count(*) FILTER (NOT tracked) AS untracked, count(bl.image_id) AS linked,
  sum(coalesce(n.n, 0)) AS edges, count(*) FILTER (n.n IS NULL) AS unsourced FROM cat c LEFT JOIN bl ON bl.ws = c.ws AND bl.image_id = c.image_id LEFT JOIN n ON n.ws = c.ws AND n.image_id = c.image_id GROUP BY c.ws""", long="edges")
def image_counts(v):
    """Events without a reason are no edges."""
    return images.counts(image_catalog_of(v), links_of(v), events(v).filter("reason <> ''"))


@book.add(f"WITH {IMG} SELECT * FROM pr")
def preferred_reason(v):
    return images.preferred_reason(events(v))


@book.add(f"WITH {IMG} SELECT DISTINCT ws, path FROM v_image_events WHERE (ws, path) NOT IN (SELECT (ws, best[2]) FROM cat)")
def untracked_files(v):
    return images.untracked(v("v_image_events"), image_catalog_of(v))


@book.add("""SELECT ws, edge_id, line_no, path FROM (SELECT *, row_number() OVER (PARTITION BY ws, edge_id ORDER BY line_no) AS r FROM v_image_events e WHERE line_no > 5 AND NOT EXISTS (SELECT 1 FROM v_image_events k WHERE k.ws = e.ws AND k.edge_id = e.edge_id AND k.line_no <= 5)) WHERE r = 1""")
def new_edges(v):
    e = v("v_image_events")
    return images.new_edges(e.filter("line_no > 5"), e.filter("line_no <= 5")).select("ws", "edge_id", "line_no", "path")


#: Names of frames, crops and strips with what they should tell; every seventh is of no known form.
FRAME_NAMES = """fn AS (SELECT user_id AS ws, event_id AS id, event_type AS slug, event_id % 7 AS k, event_id * 37 AS a, event_id * 37 + 1000 * (event_id % 5) AS b, event_id % 19 AS cells, lpad(cast(event_id * 37 AS varchar), 9, '0') AS ta, lpad(cast(event_id * 37 + 1000 * (event_id % 5) AS varchar), 9, '0') AS tb FROM events)"""


@book.add(f"""WITH {FRAME_NAMES} SELECT ws, id, CASE WHEN k IN (2, 3, 4) THEN 'filmstrip' WHEN k = 1 THEN 'frame-crop' ELSE 'frame' END AS kind, CASE WHEN k < 2 THEN a / 1000 END AS t, CASE WHEN k IN (2, 3) THEN a / 1000 END AS span_s, CASE WHEN k IN (2, 3) THEN b / 1000 END AS span_e,
  CASE WHEN k IN (2, 3) THEN cells END AS cells, CASE WHEN k = 3 THEN 4 END AS cols, CASE WHEN k = 3 THEN 12 END AS version, CASE WHEN k IN (2, 3) AND a < b AND cells BETWEEN 1 AND 16 THEN [round(a / 1000 + (i + 0.5) * (b / 1000 - a / 1000) / cells, 6) FOR i IN range(cells)] END AS timestamps,
  CASE WHEN k IN (1, 3) THEN slug END AS slug FROM fn""", long="cells cols version")
def frame_file_fields(v):
    """Names that tell what an image is, with digits beyond a long among them."""
    e = v("events")
    k, a, b, cells = F.col("event_id") % 7, F.col("event_id") * 37, F.col("event_id") * 37 + 1000 * (F.col("event_id") % 5), (F.col("event_id") % 19).cast("string")
    ta, tb = F.lpad(a.cast("string"), 9, "0"), F.lpad(b.cast("string"), 9, "0")
    strip = F.concat(F.lit("a/strip_"), ta, F.lit("_"), tb, F.lit("_n"), cells)
    path = F.when(k == 0, F.concat(F.lit("frames/t"), ta, F.lit(".jpg"))).when(k == 1, F.concat(F.lit("t"), ta, F.lit("_c0123abcd-"), "event_type", F.lit(".jpg"))).when(k == 2, F.concat(strip, F.lit(".jpg")))
    path = path.when(k == 3, F.concat(strip, F.lit("_c4_v12-"), "event_type", F.lit(".jpg"))).when(k == 4, F.concat(F.lit("strip_1_2_n"), F.repeat(cells, F.lit(30)), F.lit(".jpg"))).when(k == 5, F.concat(F.lit("t"), F.repeat(ta, F.lit(4)), F.lit(".jpg"))).otherwise("x.png")
    found = images.frame_fields(e.select(F.col("user_id").alias("ws"), F.col("event_id").alias("id"), path.alias("path")))
    return found.withColumn("timestamps", F.transform("timestamps", lambda x: F.round(x, 6))).drop("path")


#: Uncertain segments: one at each measure of loudness that has none; claims and scenes as they are.
POOL = """cd AS (SELECT ws, t, 0.5 + least(score, 0.5) AS weight, 'scene' AS source, 0 AS rank, t AS pos, 0 AS turn FROM sup UNION ALL
  SELECT ws, unnest([(s + e) / 2, s, e]), unnest([0.7, 0.55, 0.55]), unnest(['burst-mid', 'burst-edge', 'burst-edge']), 1, s, unnest([0, 1, 2]) FROM lsp UNION ALL
  SELECT ws, (s + e) / 2, least(1.0, 1.2 - coalesce(confidence, 0)), 'cp-uncertain', 2, (s + e) / 2, 0 FROM latest WHERE status <> 'verified' AND coalesce(confidence, 0) < 0.7 UNION ALL
  SELECT ws, t + 0.5, 0.6, 'asr-lowconf', 3, t + 0.5, 0 FROM v_loud WHERE db IS NULL UNION ALL SELECT ws, duration - 1, 0.65, 'endcard-rule', 4, duration - 1, 0 FROM v_videos),
pl AS MATERIALIZED (SELECT * REPLACE (cast(weight AS double) AS weight), row_number() OVER (PARTITION BY ws ORDER BY rank, pos, turn, t, weight, source) AS i FROM cd WHERE t >= 0 AND t <= 600),
mg AS (SELECT DISTINCT ws, cast(0 AS bigint) AS i, cast([] AS double[]) AS ts, cast([] AS double[]) AS wt, cast([] AS varchar[]) AS nm FROM pl UNION ALL
  SELECT ws, i, CASE WHEN k = 0 THEN list_append(ts, t) ELSE ts END, CASE WHEN k = 0 THEN list_append(wt, weight) ELSE [CASE WHEN j = k THEN greatest(wt[j], weight) ELSE wt[j] END FOR j IN range(1, len(wt) + 1)] END,
    CASE WHEN k = 0 THEN list_append(nm, source) ELSE [CASE WHEN j = k AND NOT list_contains(string_split(nm[j], '+'), source) THEN concat(nm[j], '+', source) ELSE nm[j] END FOR j IN range(1, len(nm) + 1)] END
  FROM (SELECT mg.ws, pl.i, ts, wt, nm, pl.t, pl.weight, pl.source, coalesce(list_position([abs(x - pl.t) <= 0.5 FOR x IN ts], true), 0) AS k FROM mg JOIN pl ON pl.ws = mg.ws AND pl.i = mg.i + 1)),
ed AS (SELECT ws, ts, wt, nm FROM mg QUALIFY row_number() OVER (PARTITION BY ws ORDER BY i DESC) = 1),
st AS (SELECT ws, list(round_even(t, 2) ORDER BY t) AS t, list(w ORDER BY t) AS w, list(n ORDER BY t) AS n FROM (SELECT ws, unnest(ts) AS t, unnest(wt) AS w, unnest(nm) AS n FROM ed) GROUP BY ws),
gr AS (SELECT ws, 0 AS step, t, w, n, [-1e0 FOR x IN t] AS fell, cast([] AS double[]) AS picks FROM st UNION ALL
  SELECT ws, step + 1, t, w, n, [CASE WHEN fell[j] = -1 AND t[j] = b THEN -2e0 WHEN fell[j] = -1 AND abs(t[j] - b) < 1 THEN b ELSE fell[j] END FOR j IN range(1, len(t) + 1)], list_append(picks, b)
  FROM (SELECT *, t[list_position(g, list_max(g))] AS b FROM (SELECT *, [CASE WHEN fell[j] = -1 THEN w[j] + 0.5e0 * least(coalesce(list_min([abs(t[j] - p) FOR p IN picks]) / 50, 1), 1) ELSE -1e0 END FOR j IN range(1, len(t) + 1)] AS g FROM gr WHERE step < 12) WHERE list_max(g) >= 0)),
fi AS (SELECT ws, unnest(t) AS t, unnest(w) AS weight, unnest(n) AS source, unnest(fell) AS fell FROM (SELECT * FROM gr QUALIFY row_number() OVER (PARTITION BY ws ORDER BY step DESC) = 1))"""


@book.add(f"WITH RECURSIVE {SUPPRESSED}, {LOUDEST}, {REPLAY}, {POOL} SELECT ws, t, round(weight, 9) AS weight, source, CASE WHEN fell = -1 THEN 'budget_exhausted' WHEN fell >= 0 THEN 'min_gap_displaced' END AS reason, CASE WHEN fell >= 0 THEN fell END AS displaced_by FROM fi")
def select_keyframes(v):
    """Pool of scene, burst, claim, segment and end-card candidates, merged in order; greedy picks."""
    v.keep("v_event")
    videos = v("v_videos")
    scenes = signals.suppress_scenes(signals.scene_hits(v("v_scene"), 0.25))
    unsure = v("v_loud").filter("db IS NULL").select("ws", F.col("t").alias("s"), (F.col("t") + 1).alias("e"))
    pool = saved(images.candidates(scenes, signals.loud_spans(v("v_loud")), claims(v), unsure, videos), "pool")
    return images.select_keyframes(pool, videos, 12).withColumn("weight", F.round("weight", 9))


@book.add(f"""WITH {HITS}, r AS (SELECT h.ws, h.t, unnest(list_distinct([least(greatest(h.t - 0.25, 0), 600), h.t, least(greatest(h.t + 0.25, 0), 600)])) AS at FROM hits h)
SELECT r.ws, r.t, min_by(r.at, ROW(-s.score, abs(r.at - r.t), r.at)) AS at FROM r JOIN v_scene s ON s.ws = r.ws AND s.t = r.at GROUP BY r.ws, r.t""")
def sharpest_frame(v):
    hits = signals.scene_hits(v("v_scene"), 0.25).withColumn("duration", F.lit(600.0))
    return images.sharpest(hits, v("v_scene"), 0.25)


# storage

CATEGORY = "CASE WHEN regexp_matches(path, '(^|/)clips/') THEN 'clips' WHEN regexp_matches(path, '(^|/)cache/') THEN 'media' WHEN path LIKE '%.jpg' THEN 'captures' WHEN path LIKE '%.mp4' THEN 'media' ELSE 'text' END"


@book.add(f"""WITH f AS (SELECT *, {CATEGORY} AS category FROM v_files) SELECT ws, coalesce(sum(size) FILTER (category = 'media'), 0) AS media, coalesce(sum(size) FILTER (category = 'captures'), 0) AS captures, coalesce(sum(size) FILTER (category = 'clips'), 0) AS clips,
coalesce(sum(size) FILTER (category = 'text'), 0) AS text, sum(size) AS total FROM f GROUP BY ROLLUP (ws)""", long="media captures clips text total")
def storage_report(v):
    return storage.storage_report(v("v_files"))


@book.add("SELECT ws, date_diff('day', max(mtime), DATE '2030-01-01') AS age_days, sum(size) AS size FROM v_files GROUP BY ws HAVING date_diff('day', max(mtime), DATE '2030-01-01') > 30", long="size")
def stale_workspaces(v):
    return storage.stale(v("v_files"), F.to_date(F.lit("2030-01-01")), 30)


@book.add(f"SELECT ws, {CATEGORY} AS category, count(*) AS files, sum(size) AS size FROM v_files WHERE {CATEGORY} IN ('media', 'clips') GROUP BY ALL", long="size")
def purge_plan(v):
    return storage.purge_plan(v("v_files"), ["media", "clips"])


@book.add("""WITH n AS (SELECT DISTINCT ws, 1 AS x FROM v_files WHERE ws % 5 <> 0), c AS (SELECT DISTINCT ws, 1 AS x FROM v_files WHERE ws % 7 <> 0)
SELECT * FROM (SELECT coalesce(n.ws, c.ws) AS ws, CASE WHEN c.x IS NULL THEN 'new' WHEN n.x IS NULL THEN 'gone' WHEN n.ws % 3 = 0 THEN 'changed' END AS state FROM n FULL JOIN c ON n.ws = c.ws) WHERE state IS NOT NULL""")
def changed_workspaces(v):
    """Against a cache in which every third timeline has other sizes, some are missing and some are new."""
    files = v("v_files")
    old = files.withColumn("size", F.when(F.col("ws") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return storage.changed(storage.fingerprint(files.filter("ws % 5 <> 0")), storage.fingerprint(old.filter("ws % 7 <> 0")))


@book.add("""WITH e AS (SELECT s_name AS name, s_suppkey % 4 AS content FROM supplier WHERE s_suppkey % 3 <> 0), x AS (SELECT s_name AS name, s_suppkey % 2 AS content, s_suppkey % 5 <> 0 AS owned FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(e.name, x.name) AS name, CASE WHEN e.name IS NULL THEN CASE WHEN owned THEN 'remove' ELSE 'keep' END WHEN x.name IS NULL THEN 'publish' WHEN NOT owned THEN 'refuse' WHEN e.content = x.content THEN 'keep' ELSE 'publish' END AS action FROM e FULL JOIN x ON e.name = x.name""")
def reconcile(v):
    s = v("supplier").withColumnRenamed("s_name", "name")
    want = s.filter("s_suppkey % 3 <> 0").select("name", (F.col("s_suppkey") % 4).alias("content"))
    have = s.filter("s_suppkey % 2 = 0").select("name", (F.col("s_suppkey") % 2).alias("content"), (F.col("s_suppkey") % 5 != 0).alias("owned"))
    return storage.reconcile(want, have)


@book.add("""WITH m AS (SELECT user_id AS name, event_type AS metric, count(*) AS value FROM events GROUP BY ALL), g AS (SELECT name, metric, greatest(0, cast(floor(value * 0.8) AS bigint) - 2) AS lo, cast(floor(value * 1.2) AS bigint) + 2 AS hi FROM m WHERE name % 10 <> 0)
SELECT m.name, m.metric, m.value + m.name % 7 AS value, coalesce(m.value + m.name % 7 BETWEEN lo AND hi, false) AS ok FROM m LEFT JOIN g USING (name, metric)""")
def range_gate(v):
    m = v("events").groupBy(F.col("user_id").alias("name"), F.col("event_type").alias("metric")).agg(F.count("*").alias("value"))
    return storage.range_gate(m.withColumn("value", F.col("value") + F.col("name") % 7), storage.golden_bands(m.filter("name % 10 <> 0")))


@book.add("""WITH m AS (SELECT user_id AS name, event_type AS metric, count(*) AS value FROM events GROUP BY ALL), g AS (SELECT name, metric, greatest(0, cast(floor(value * 0.8) AS bigint) - 2) AS lo, cast(floor(value * 1.2) AS bigint) + 2 AS hi FROM m),
l AS (SELECT user_id AS name, max(event_type) AS value, min(event_type) AS want, count(*) AS wall FROM events GROUP BY user_id)
SELECT m.name, m.metric AS "check", m.value + m.name % 7 BETWEEN lo AND hi AS ok FROM m JOIN g USING (name, metric) UNION ALL SELECT name, 'mode', CASE WHEN name % 4 = 0 THEN false ELSE value = CASE WHEN name % 2 = 0 THEN want ELSE value END END FROM l UNION ALL SELECT name, 'wall', wall <= 40 + name % 5 FROM l""")
def release_gate(v):
    """Metrics, a label and the number of events as time; every fourth user has no label to be held against."""
    e, n = v("events").withColumnRenamed("user_id", "name"), F.col("name")
    m = e.groupBy("name", F.col("event_type").alias("metric")).agg(F.count("*").alias("value"))
    one = saved(e.groupBy("name").agg(F.max("event_type").alias("value"), F.min("event_type").alias("least"), F.count("*").alias("wall")), "users")
    labels = one.select("name", F.lit("mode").alias("key"), "value")
    wanted = one.select("name", F.lit("mode").alias("key"), F.when(n % 4 == 0, None).when(n % 2 == 0, F.col("least")).otherwise(F.col("value")).alias("value"))
    return storage.gate(m.withColumn("value", F.col("value") + n % 7), storage.golden_bands(m), labels, wanted, one.select("name", "wall"), one.select("name", (40 + n % 5).alias("ceiling")))


@book.add(f"""WITH {IMG}, i AS (SELECT c.ws, best[2] AS path, coalesce(pr.reason, '') AS reason FROM cat c LEFT JOIN pr ON pr.ws = c.ws AND pr.image_id = c.image_id)
SELECT ws, path AS file, reason FROM i UNION ALL SELECT ws, substr(path, 8), reason FROM i""")
def capture_reasons(v):
    return images.capture_reasons(image_catalog_of(v).select("ws", "image_id", "path").join(images.preferred_reason(events(v)), ["ws", "image_id"], "left"))


# terms

#: Each turn corrects the one before it; some are notes, with and without blanks ahead of the parenthesis.
HARVEST = r"""cor AS (SELECT ws, text AS asr, concat(CASE pos % 5 WHEN 0 THEN chr(9) || ' (note ' WHEN 1 THEN '(' ELSE '' END, lead(text) OVER (PARTITION BY ws ORDER BY pos)) AS corrected, lead(text) OVER (PARTITION BY ws ORDER BY pos) IS NULL AS ends FROM v_seg), st AS (SELECT ws, row_number() OVER () AS id, corrected, list_distinct([CASE WHEN x LIKE '%ly' AND length(x) >= 4 THEN x[1:-3] WHEN x LIKE '%s' AND length(x) >= 3 THEN x[1:-2] ELSE x END for x in string_split_regex(corrected, '\s+') if x <> '']) AS a,
  list_distinct([CASE WHEN x LIKE '%ly' AND length(x) >= 4 THEN x[1:-3] WHEN x LIKE '%s' AND length(x) >= 3 THEN x[1:-2] ELSE x END for x in string_split_regex(asr, '\s+') if x <> '']) AS b FROM cor WHERE NOT ends AND NOT regexp_matches(corrected, '^\s*\(')),
hv AS MATERIALIZED (SELECT ws, term, count(*) AS n FROM (SELECT ws, unnest([x for x in a if NOT list_contains(b, x)]) AS term FROM st) WHERE length(term) >= 2 AND regexp_full_match(term, '[\p{L}\p{N}]+') AND NOT regexp_matches(term, '(ing|ed)$') GROUP BY ALL)"""


def harvested(v):
    from pyspark.sql import Window

    seg = v("v_seg")
    ahead = F.when(F.col("pos") % 5 == 0, "\t (note ").when(F.col("pos") % 5 == 1, "(").otherwise("")
    pairs = seg.select("ws", F.col("text").alias("asr"), ahead.alias("ahead"), F.lead("text").over(Window.partitionBy("ws").orderBy("pos")).alias("next")).filter("next IS NOT NULL").select("ws", "asr", F.concat("ahead", "next").alias("corrected"))
    return terms.harvest(pairs, ["ly", "s"], ["ing", "ed"])


@book.add(f"WITH {HARVEST} SELECT * FROM hv")
def harvest_terms(v):
    return harvested(v)


MERGED = """store AS MATERIALIZED (SELECT cast(ws AS varchar) AS ws, term, n + 1 AS n FROM hv WHERE ws % 2 = 0 UNION ALL SELECT DISTINCT 'legacy', term, 1 FROM hv WHERE length(term) % 3 = 0),
inc AS MATERIALIZED (SELECT cast(ws AS varchar) AS ws, term, n FROM hv WHERE ws % 3 = 0), kept AS MATERIALIZED (SELECT store.* FROM store ANTI JOIN inc ON inc.ws = store.ws UNION ALL SELECT ws, term, n FROM inc),
mg AS MATERIALIZED (SELECT term, ws, n FROM kept WHERE ws <> 'legacy' UNION ALL SELECT k.term, k.ws, k.n FROM kept k ANTI JOIN (SELECT DISTINCT term FROM kept WHERE ws <> 'legacy') r ON r.term = k.term WHERE k.ws = 'legacy')"""


def glossaries(v):
    h = harvested(v).withColumn("w", F.col("ws")).withColumn("ws", F.col("ws").cast("string"))
    store = h.filter("w % 2 = 0").select("ws", "term", (F.col("n") + 1).alias("n")).union(h.filter("length(term) % 3 = 0").select(F.lit("legacy"), "term", F.lit(1).cast("long")).distinct())
    return store, h.filter("w % 3 = 0")


def merged(v):
    return terms.merge_glossary(*glossaries(v))


@book.add(f"WITH {HARVEST}, {MERGED} SELECT (SELECT count(DISTINCT term) FROM mg WHERE term NOT IN (SELECT term FROM store)) AS added, (SELECT count(DISTINCT term) FROM mg) AS total")
def glossary_change(v):
    store, new = glossaries(v)
    return terms.glossary_change(store, terms.merge_glossary(store, new))


@book.add(r"""SELECT DISTINCT term, 'legacy' AS ws, CAST(1 AS BIGINT) AS n FROM (SELECT CASE WHEN suffix(x, 'ly') AND length(x) >= 4 THEN x[1 : length(x) - 2] WHEN suffix(x, 's') AND length(x) >= 3 THEN x[1 : length(x) - 1] ELSE x END AS term
  FROM (SELECT unnest(string_split_regex(text, '\s+')) AS x FROM benchmark)) WHERE length(term) >= 2 AND regexp_full_match(term, '[\p{L}\p{N}]+') AND NOT regexp_matches(term, '(ing|ed)$')""")
def flat_glossary(v):
    """All words of the benchmark as a glossary of the old form."""
    return terms.flat_glossary(v("benchmark").select(F.explode(F.split("text", r"\s+")).alias("word")), ["ly", "s"], ["ing", "ed"])


@book.add(f"WITH {HARVEST}, {MERGED} SELECT * FROM mg")
def merge_glossary(v):
    return merged(v)


@book.add(f"""WITH {HARVEST}, {MERGED}, b AS (SELECT term, count(DISTINCT CASE WHEN ws <> 'legacy' THEN ws END) AS sources, sum(n) AS n FROM mg GROUP BY term ORDER BY sources DESC, n DESC, term LIMIT 50)
SELECT row_number() OVER (ORDER BY sources, n, term DESC) AS place, term FROM b""")
def hotwords(v):
    return terms.hotwords(merged(v))


@book.add(r"""WITH raw AS (SELECT page_id AS ws, 'title' AS field, 1 AS place, concat('The ', url, ' 12:30 #tag 2024') AS x FROM pages UNION ALL SELECT page_id, 'description', 3, html FROM pages),
cl AS (SELECT ws, field, place, translate(regexp_replace(x, 'https?://\S+|@\S+|#\S+|\b\d{1,2}:\d{2}(:\d{2})?\b|[▶►★☆♥♡]', ' ', 'g'), '[]()<>{}|·,、/\\"''“”‘’!?~*_', '                         ') AS x FROM raw),
f AS (SELECT ws, field, place, list_filter(regexp_extract_all(x, '[0-9A-Za-z가-힣]{2,}'), lambda w: NOT regexp_full_match(w, '[0-9]+') AND lower(w) NOT IN ('the', 'and', 'div')) AS tk FROM cl),
e AS (SELECT ws, field, place, unnest(range(len(tk))) AS pos, tk FROM f), x AS (SELECT ws, field, place, pos, tk[pos + 1] AS term FROM e),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ws, term ORDER BY place, pos) AS r FROM x) WHERE r = 1), k AS (SELECT *, row_number() OVER (PARTITION BY ws, field ORDER BY pos) AS k FROM u),
n AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY CASE WHEN k > CASE field WHEN 'title' THEN 6 ELSE 4 END THEN 1 ELSE 0 END, place, pos) AS n FROM k) SELECT ws, term, field FROM n WHERE n <= 12""")
def prior_terms(v):
    """Titles with noise and whole pages as descriptions; numbers and stop words are no terms."""
    p, stop = v("pages"), ["the", "and", "div"]
    title = F.concat(F.lit("The "), "url", F.lit(" 12:30 #tag 2024"))
    row = lambda field, text: p.select(F.col("page_id").alias("ws"), F.lit(field).alias("field"), terms.prior_words(text, stop).alias("tokens"))
    return terms.prior_terms(row("title", title).union(row("description", F.col("html"))), {"title": 6, "uploader": 2, "description": 4}, ["title", "uploader", "description"])


@book.add("SELECT DISTINCT ws, 'title' AS field, trim(regexp_replace(CASE WHEN strpos(f, '.') > 1 THEN f[1 : length(f) - strpos(reverse(f), '.')] ELSE f END, '[._-]+', ' ', 'g')) AS text FROM (SELECT ws, concat(CASE WHEN ws % 7 = 0 THEN '.' ELSE '' END, 'cut-of_', string_split(path, '/')[-1]) AS f FROM v_files) WHERE ws % 7 <> 0")
def local_priors(v):
    """Titles from file names; hidden files give none."""
    hidden = F.when(F.col("ws") % 7 == 0, ".").otherwise("")
    return readers.local_priors(v("v_files").select("ws", F.concat(F.lit("a/"), hidden, F.lit("cut-of_"), F.regexp_extract("path", "([^/]*)$", 1)).alias("path"))).distinct()


# scalar functions


@book.add("""SELECT l_orderkey, l_linenumber, l_quantity, concat(cast(cast(l_quantity AS bigint) // 60 AS varchar), ':', lpad(cast(cast(l_quantity AS bigint) % 60 AS varchar), 2, '0')) AS clock, cast(l_quantity AS double) AS seconds, printf('00:00:%02d.500', cast(l_quantity AS bigint) % 60) AS stamp,
  CASE WHEN l_quantity * 123457 >= 1048576 THEN printf('%.1f MB', l_quantity * 123457 / 1048576) WHEN l_quantity * 123457 >= 1024 THEN printf('%.1f KB', l_quantity * 123457 / 1024) END AS size FROM lineitem""", long="l_linenumber")
def times_and_sizes(v):
    q = F.col("l_quantity").cast("long")
    clock = F.concat(F.floor(q / 60).cast("string"), F.lit(":"), F.lpad((q % 60).cast("string"), 2, "0"))
    return v("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", clock.alias("clock"), tm.parse_ts(clock).alias("seconds"), tm.fmt_ts(q % 60 + 0.5).alias("stamp"), tm.human_bytes(F.col("l_quantity") * 123457).alias("size"))


@book.add(r"""SELECT doc_id, trim(regexp_replace(lower(substr(text, 1, 60)), '[^\p{L}\p{N}]+', '-', 'g'), '-') AS slug, list_has_any(list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ['the']) AS has_the FROM documents""")
def text_functions(v):
    return v("documents").select("doc_id", tx.slug(F.substring("text", 1, 60)).alias("slug"), F.array_contains(tx.tokens(tx.fold(F.col("text"))), "the").alias("has_the"))
