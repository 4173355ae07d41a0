"""Queries of whole videos and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, knowledge, projections, search, sequences, signals, spans, summary, transcript
from ..sources.tables import folder, saved
from .base import Book
from .text_queries import LEADERS, names
from .timeline_queries import COVERAGE, HITS, LOUDEST, REPLAY, SUPPORT, claims, grounded
from .timeline_queries import ready as ready_by_support

book = Book()

FACTS = f"""{HITS}, {LOUDEST}, hl AS (SELECT ws, count(*) AS n FROM lsp GROUP BY ws), sc AS (SELECT ws, count(*) AS n FROM hits GROUP BY ws), sg AS (SELECT ws, count(*) AS n, sum(e - s) AS sp, count(*) FILTER (CASE WHEN conf IS NOT NULL THEN conf < 0.6 ELSE logprob < -1 OR no_speech_prob > 0.5 END) AS u FROM v_seg GROUP BY ws),
oc AS (SELECT ws, count(*) AS n FROM v_hits WHERE label = 'view' GROUP BY ws),
fc AS (SELECT v.ws, v.duration, coalesce(sg.n, 0) AS segments, coalesce(sg.u, 0) AS uncertain, coalesce(sc.n, 0) AS scenes, coalesce(hl.n, 0) AS highlights, coalesce(oc.n, 0) AS ocr_spans, round(least(coalesce(sp, 0) * 10 / duration, 1), 4) AS speech_ratio
  FROM v_videos v LEFT JOIN sg USING (ws) LEFT JOIN sc USING (ws) LEFT JOIN oc USING (ws) LEFT JOIN hl USING (ws)),
md AS (SELECT *, CASE WHEN speech_ratio < 0.35 AND ocr_spans / (duration / 60) >= 5 AND ocr_spans >= 5 THEN 'caption-led' WHEN segments = 0 AND scenes <= 1 AND highlights = 0 THEN 'loop' WHEN segments = 0 AND ocr_spans > 0 THEN 'silent with text' WHEN segments = 0 THEN 'silent'
  WHEN speech_ratio >= 0.35 AND ocr_spans > 0 THEN 'text-on-screen' WHEN speech_ratio < 0.35 THEN 'visual-led' ELSE 'speech-led' END AS mode FROM fc)"""


def facts(v):
    v.keep("v_event")
    hits = signals.scene_hits(v("v_scene"), 0.25)
    seg = v("v_seg").withColumn("e", F.col("s") + (F.col("e") - F.col("s")) * 10)  # long segments, so that all modes occur
    return summary.video_facts(v("v_videos"), seg, hits, signals.loud_spans(v("v_loud")), v("v_hits").filter("label = 'view'"))


@book.add(f"WITH {FACTS} SELECT * FROM md")
def content_mode(v):
    return facts(v).withColumn("mode", summary.content_mode())


#: A question that claims and transcripts are searched for, and how its words stand without their particle.
QUESTION, ASKED = "What do purchases and the erroring views say?", ["what", "do", "purchase", "and", "the", "error", "view", "say"]
HEADS = f"""ae AS (SELECT ws, label, min(t) AS s, round(max(t) + 1.5, 2) AS e FROM (SELECT *, sum(nw) OVER (PARTITION BY ws ORDER BY t, label, conf ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT *, CASE WHEN lag(label) OVER w = label AND t - round(lag(t) OVER w + 1.5, 2) <= 2.0 THEN 0 ELSE 1 END AS nw FROM v_hits WINDOW w AS (PARTITION BY ws ORDER BY t, label, conf))) GROUP BY ws, run, label),
b1 AS (SELECT ws, (list(concat(s, '-', e, ' ', score) ORDER BY score DESC, s))[1:3] AS bursts, count(*) AS bursts_total FROM lsp GROUP BY ws), b2 AS (SELECT ws, (list(concat(t, '') ORDER BY t))[1:5] AS scene_times, count(*) AS scene_times_total FROM hits GROUP BY ws),
b3 AS (SELECT ws, (list(concat(label, ' ', s, '-', e) ORDER BY e - s DESC, s, label))[1:3] AS events, count(*) AS events_total FROM ae GROUP BY ws), b4 AS (SELECT ws, (list(concat(s, '-', e) ORDER BY s))[1:5] AS open_spans, count(*) AS open_spans_total FROM gap GROUP BY ws),
b5 AS (SELECT ws, [concat(75 * i, ' part ', i) FOR i IN range(6)] AS chapters, 8 AS chapters_total FROM v_videos WHERE ws % 2 = 0), b6 AS (SELECT ws, CASE WHEN ws % 3 = 0 THEN NULL WHEN ws % 5 = 0 THEN 'legacy' WHEN ws % 2 = 0 THEN 'same' ELSE 'changed' END AS drift FROM v_videos),
b7 AS (SELECT ws, (list(cp_id ORDER BY first_line, cp_id))[1:3] AS asked_claims FROM latest WHERE {" OR ".join(f"contains(lower(concat(cp_id, ' ', hypothesis)), '{x}')" for x in ASKED)} GROUP BY ws)"""


@book.add(COVERAGE.rstrip() + f""", {FACTS}, {HEADS} SELECT md.*, s.* EXCLUDE (ws), bursts, bursts_total, scene_times, scene_times_total, events, events_total, open_spans, open_spans_total, chapters, chapters_total, drift, asked_claims
  FROM md LEFT JOIN status s ON s.ws = md.ws LEFT JOIN b1 ON b1.ws = md.ws LEFT JOIN b2 ON b2.ws = md.ws LEFT JOIN b3 ON b3.ws = md.ws LEFT JOIN b4 ON b4.ws = md.ws LEFT JOIN b5 ON b5.ws = md.ws LEFT JOIN b6 ON b6.ws = md.ws LEFT JOIN b7 ON b7.ws = md.ws""", long="chapters_total")
def brief(v):
    """A row per video: facts, readiness, top signals, gaps, chapters, drift of hotwords, and claims that a question is about."""
    v.keep("v_event")
    held, videos, text = claims(v), v("v_videos"), F.concat
    start, number = F.col("s").cast("string"), lambda c: F.col(c).cast("string")
    span = text(start, F.lit("-"), number("e"))
    chapters = videos.filter("ws % 2 = 0").select("ws", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    made = videos.select("ws", F.when(F.col("ws") % 3 == 0, "captions").otherwise("whisper").alias("source"), (F.col("ws") % 5 != 0).alias("stamped"), F.when(F.col("ws") % 2 == 0, "alpha beta gamma").otherwise("delta gamma").alias("hotwords"), F.lit("").alias("rejected"), F.lit("gamma").alias("prior"))
    told = held.select("ws", F.col("first_line").alias("pos"), F.col("first_line").alias("s"), F.lower(F.concat_ws(" ", "cp_id", "hypothesis")).alias("folded"), "cp_id")
    question = videos.limit(1).select(F.lit(0).alias("query"), F.explode(search.intent_terms(F.lit(QUESTION), ["s", "ing"])).alias("term"))
    asked = search.intent_hits(told, question, 3, by_count=False).join(told.select("ws", "pos", "cp_id"), ["ws", "pos"])
    return summary.brief(
        facts(v), evidence.coverage_status(held, videos),
        summary.heads(signals.loud_spans(v("v_loud")), "bursts", text(span, F.lit(" "), number("score")), [F.desc("score"), "s"], 3),
        summary.heads(signals.scene_hits(v("v_scene"), 0.25), "scene_times", number("t"), ["t"], 5),
        summary.heads(signals.audio_events(v("v_hits")), "events", text(F.col("label"), F.lit(" "), span), [F.desc(F.col("e") - F.col("s")), "s", "label"], 3),
        summary.heads(spans.coverage_gaps(held, videos), "open_spans", span, ["s"], 5),
        summary.heads(chapters, "chapters", text((F.col("k") * 75).cast("string"), F.lit(" part "), number("k")), ["k"], 6),
        projections.hotword_drift(made, "alpha beta"),
        summary.heads(asked, "asked_claims", F.col("cp_id"), ["pos"], 3).drop("asked_claims_total"),
    )


@book.add(f"WITH {FACTS} SELECT mode, label AS tag, count(*) AS hits FROM v_hits h JOIN md ON md.ws = h.ws GROUP BY ALL")
def tag_index(v):
    return summary.tag_index(v("v_hits").withColumnRenamed("label", "tag"), facts(v).withColumn("mode", summary.content_mode()))


@book.add("SELECT ws, role AS speaker, count(*) AS n, arg_min(text, ROW(s, text)) AS first, arg_max(text, ROW(s, text)) AS last FROM v_seg WHERE trim(text) <> '' GROUP BY ws, role")
def quote_log(v):
    return summary.quote_log(v("v_seg").select("ws", F.col("s").alias("t"), F.col("role").alias("speaker"), "text"))


@book.add("SELECT cast(subj AS varchar) AS label, 'subject' AS side, count(*) AS n FROM v_edge GROUP BY ALL UNION ALL SELECT cast(obj AS varchar), 'object', count(*) FROM v_edge GROUP BY ALL")
def relation_log(v):
    return summary.relation_log(v("v_edge"))


#: Claims with situation, speakers, entities, quotes and a relation, made of every claim; blanks and nulls among them.
ROWS = """td AS (SELECT ws, cp_id, s, e, status, hypothesis, first_line, confidence, CASE WHEN event_id % 3 = 1 THEN 'rise' END AS arc, CASE WHEN event_id % 4 <> 0 THEN concat('situation ', cast(event_id AS varchar)) END AS situation, concat('speaker ', cast(event_id % 9 AS varchar)) AS sp,
  [concat('entity ', cast(event_id % 40 AS varchar)), concat('speaker ', cast(event_id % 7 AS varchar)), CASE WHEN event_id % 6 = 0 THEN ' ' ELSE concat('entity ', cast(event_id AS varchar)) END] AS en, CASE WHEN event_id % 5 <> 0 THEN s END AS t1, e AS t2, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE concat('line ', cast(event_id AS varchar)) END AS x1 FROM latest),
ap AS (SELECT DISTINCT trim(x) AS label, ws, cp_id, s, e, status, role, left(coalesce(situation, hypothesis), 80) AS situation FROM (SELECT *, sp AS x, 'speaker' AS role FROM td UNION ALL SELECT *, unnest(en), 'entity' FROM td) WHERE trim(x) <> ''),
qt AS (SELECT ws, row_number() OVER (PARTITION BY ws ORDER BY coalesce(t, 0), cp_id, k) AS place, cp_id, t, speaker, text FROM (SELECT ws, cp_id, 0 AS k, t1 AS t, sp AS speaker, x1 AS text FROM td UNION ALL SELECT ws, cp_id, 1, t2, NULL, concat(hypothesis, '!') FROM td) WHERE trim(text) <> ''),
rl AS (SELECT ws, cp_id, sp AS subj, 'corrects' AS pred, en[1] AS obj FROM td WHERE status = 'corrected'),
rr AS (SELECT DISTINCT label, ws, cp_id, subj, pred, obj FROM (SELECT subj AS label, * FROM rl UNION ALL SELECT obj, * FROM rl)),
nt AS (SELECT DISTINCT label FROM ap WHERE length(label) % 3 = 0),
ix AS (SELECT label, count(DISTINCT ws) AS videos, count(*) AS rows FROM ap GROUP BY label),
du AS (SELECT *, rows >= 2 OR quoted OR related OR noted AS durable FROM (SELECT *, label IN (SELECT speaker FROM qt WHERE speaker IS NOT NULL) AS quoted, label IN (SELECT label FROM rr) AS related, label IN (SELECT label FROM nt) AS noted FROM ix)),
wr AS (SELECT ws, CASE WHEN bool_or(status <> 'hypothesized') THEN 'converged' ELSE 'verify_more' END AS advice FROM latest GROUP BY ws)"""
TOLD = f"{REPLAY}, {ROWS}"


def told(v):
    n, numbered = F.col("event_id"), lambda word, x: F.concat(F.lit(word), x.cast("string"))
    speaker = numbered("speaker ", n % 9)
    last = F.when(n % 6 == 0, " ").otherwise(numbered("entity ", n))
    quote = lambda t, who, text: F.struct(t.alias("t"), who.alias("speaker"), text.alias("text"))
    first = quote(F.when(n % 5 != 0, F.col("s")), speaker, F.when(n % 3 == 0, " ").otherwise(numbered("line ", n)))
    made = claims(v).select(
        "ws", "cp_id", "s", "e", "status", "hypothesis", "first_line", "confidence", F.when(n % 3 == 1, "rise").otherwise("").alias("arc"), F.array("hypothesis").alias("tags"), F.when(n % 4 != 0, numbered("situation ", n)).alias("situation"), F.array(speaker).alias("speakers"), F.array(numbered("entity ", n % 40), numbered("speaker ", n % 7), last).alias("entities"),
        F.array(first, quote(F.col("e"), F.lit(None).cast("string"), F.concat("hypothesis", F.lit("!")))).alias("quotes"), F.when(F.col("status") == "corrected", speaker).alias("subj"),
    )
    return saved(made, "told")


def triples_of(rows):
    return rows.filter("subj IS NOT NULL").select("ws", "cp_id", "subj", F.lit("corrects").alias("pred"), F.col("entities")[0].alias("obj"))


def notes_of(rows):
    """Of every label a note: written, blank or the placeholder."""
    note = F.when(F.length("label") % 3 == 0, "a note").when(F.length("label") % 3 == 1, " ").otherwise("(to fill in)")
    return knowledge.written_notes(rows.select("label").distinct().withColumn("note", note), "(to fill in)\n")


def entities(rows, named):
    quoted = summary.quote_rows(rows).select(F.col("speaker").alias("label")).filter("label IS NOT NULL")
    return knowledge.durable(knowledge.entity_index(named), quoted, summary.relation_rows(triples_of(rows)), noted=notes_of(named))


def ready(v):
    """Readiness of timelines whose claims all span the whole."""
    whole = claims(v).withColumns({"s": F.lit(0.0), "e": F.col("duration")})
    return evidence.readiness(evidence.coverage_status(whole, v("v_videos")))


@book.add(SUPPORT + f""", {ROWS}, {FACTS}, pm AS (SELECT td.* FROM td JOIN settled x ON x.ws = td.ws AND x.cp_id = td.cp_id WHERE x.level <> 'unsupported'),
hd AS (SELECT ws, arg_min(coalesce(situation, hypothesis), first_line) AS said FROM pm GROUP BY ws), lb AS (SELECT ws, string_agg(x, ',' ORDER BY x) AS labels FROM (SELECT DISTINCT ws, trim(x) AS x FROM (SELECT ws, sp AS x FROM pm UNION ALL SELECT ws, unnest(en) FROM pm) WHERE trim(x) <> '') GROUP BY ws),
tg AS (SELECT ws, string_agg(DISTINCT replace(hypothesis, ' ', '-'), ',' ORDER BY replace(hypothesis, ' ', '-')) AS tags FROM pm GROUP BY ws), nr AS (SELECT ws, min(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x[1] <> '(')[1]) AS line FROM v_seg GROUP BY ws)
SELECT md.ws, mode, advice, claims, left(coalesce(line, said, CASE WHEN claims > 0 THEN 'to be verified' ELSE '—' END), 80) AS head, coalesce(labels, '') AS labels, coalesce(tags, '') AS tags, speech_ratio, scenes, highlights
FROM md JOIN rd USING (ws) LEFT JOIN hd USING (ws) LEFT JOIN lb USING (ws) LEFT JOIN tg USING (ws) LEFT JOIN nr USING (ws)""")
def video_summary(v):
    """The turns of conversations stand for the narratives of the timelines of their number."""
    levels = saved(grounded(v)[0].select("ws", "cp_id", "duration", "transcript_support", "visual_support", "level"), "levels")
    rows = saved(told(v).join(levels, ["ws", "cp_id"]), "rows")
    narratives = v("v_seg").select("ws", F.concat(F.lit("(to fill in)\n\n "), "text").alias("text"))
    out = summary.video_summary(facts(v), ready_by_support(v, rows), rows, narratives)
    return out.withColumns({"labels": F.array_join("labels", ","), "tags": F.array_join("tags", ",")})


@book.add(f"WITH {TOLD} SELECT * FROM ap")
def entity_appearances(v):
    return knowledge.appearances(told(v))


@book.add(f"WITH {TOLD} SELECT * FROM qt")
def quote_rows(v):
    return summary.quote_rows(told(v))


@book.add(f"WITH {TOLD} SELECT * FROM rr")
def relation_rows(v):
    return summary.relation_rows(triples_of(told(v)))


@book.add(f"WITH {TOLD} SELECT * FROM du")
def durable_entities(v):
    rows = told(v)
    return entities(rows, saved(knowledge.appearances(rows), "named"))


@book.add(f"""WITH {TOLD} SELECT label, 'note' AS task FROM du WHERE durable AND NOT noted UNION ALL SELECT label, 'relation' FROM du WHERE rows >= 3 AND NOT related
UNION ALL SELECT cast(ws AS varchar), 'narrative' FROM wr WHERE advice = 'converged' AND ws NOT IN (SELECT ws FROM v_seg)""")
def improvement_queue(v):
    """Conversations stand for the narratives of the timelines of their number."""
    rows = told(v)
    named = saved(knowledge.appearances(rows), "named")
    return summary.improvement_queue(entities(rows, named), notes_of(named), ready(v), v("v_seg").select("ws"))


@book.add(f"""WITH RECURSIVE {LEADERS}, {TOLD} SELECT (SELECT count(*) FROM du) AS entities, (SELECT count(*) FROM du WHERE durable) AS durable, (SELECT count(*) FROM du WHERE NOT durable) AS candidates, (SELECT count(*) FROM rl) AS relations,
  (SELECT count(*) FROM (SELECT leader FROM gr WHERE i > 0 GROUP BY leader HAVING count(*) > 1)) AS alias_groups, (SELECT count(*) FROM qt) AS quotes, (SELECT count(*) FROM nt) AS notes_filled, (SELECT sum(length(html)) FROM pages) AS index_bytes, (SELECT sum(length(html)) FROM pages) > 10240 AS over_limit""", long="index_bytes")
def layer_metrics(v):
    """Pages stand for the index, part names for the labels whose spellings are compared."""
    rows = told(v)
    named = saved(knowledge.appearances(rows), "named")
    labels = names(v)
    groups = knowledge.alias_leaders(labels, saved(knowledge.alias_pairs(labels), "pairs"), folder(labels.sparkSession))
    return summary.layer_metrics(entities(rows, named), triples_of(rows), groups, summary.quote_rows(rows), notes_of(named), v("pages").select(F.length("html").alias("size")))


@book.add(f"""WITH {TOLD} SELECT grp, count(*) AS videos, round(sum(duration) / 3600, 4) AS hours, sum(claims) AS claims, count(*) FILTER (advice = 'converged') AS converged FROM v_videos JOIN (SELECT ws, count(*) AS claims FROM v_cp_log GROUP BY ws) USING (ws) LEFT JOIN wr USING (ws) GROUP BY ROLLUP (grp)""", long="claims")
def group_index(v):
    n = v("v_cp_log").groupBy("ws").agg(F.count("*").alias("claims"))
    return knowledge.group_index(v("v_videos").join(n, "ws").join(ready(v).select("ws", "advice"), "ws", "left"))


@book.add(f"WITH {REPLAY}, {HITS}, g AS (SELECT *, lag(e) OVER w AS b, lag(role) OVER w AS sp FROM v_seg WINDOW w AS (PARTITION BY ws ORDER BY s, pos)) SELECT ws, s AS t, 'weak_claim' AS why FROM latest WHERE confidence < 0.7 UNION ALL SELECT ws, s, 'weak_segment' FROM g WHERE conf < 0.6 UNION ALL SELECT ws, b, 'silence' FROM g WHERE s - b >= 5 UNION ALL SELECT ws, s, 'speaker_change' FROM g WHERE sp <> role UNION ALL SELECT ws, t, 'burst' FROM v_hits WHERE conf >= 0.9 UNION ALL SELECT ws, t, 'scene_change' FROM hits")
def verification_points(v):
    seg = v("v_seg").withColumnRenamed("role", "speaker")
    return summary.verification_points(claims(v), seg, v("v_hits").filter("conf >= 0.9").withColumnRenamed("t", "s"), signals.scene_hits(v("v_scene"), 0.25), 5.0)


@book.add(f"WITH {HITS} SELECT v.ws, count(h.t) AS scenes, count(h.t) / (max(v.duration) / 60) >= 10 AS montage FROM v_videos v LEFT JOIN hits h ON h.ws = v.ws GROUP BY v.ws")
def montage(v):
    return summary.montage(signals.scene_hits(v("v_scene"), 0.25), v("v_videos"))


@book.add("SELECT vec_id, CASE WHEN m >= 0.05 THEN 'close-up' WHEN m >= 0.008 THEN 'medium' ELSE 'long' END AS scale FROM (SELECT vec_id, greatest(abs(embedding[1]::double * embedding[2]::double), abs(embedding[3]::double * embedding[4]::double)) AS m FROM embeddings)")
def shot_scale(v):
    x = lambda k: F.abs(F.get("embedding", F.lit(k)).cast("double"))
    zero = F.lit(0.0)
    return v("embeddings").select("vec_id", summary.shot_scale(F.array(F.array(zero, zero, x(0), x(1)), F.array(zero, zero, x(2), x(3)))).alias("scale"))


@book.add("""WITH d AS (SELECT o_orderkey AS ws, floor(o_totalprice) / 64e0 AS duration FROM orders), n AS (SELECT *, greatest(cast(ceil(duration / 112) AS bigint), 1) AS n FROM d WHERE duration > 0),
w AS (SELECT ws, strip, greatest(least(cast(ceil(duration / n / 7) AS bigint), 16), 1) AS cells, cast(round(cast(cast(duration * strip / n AS varchar) AS decimal(32, 18)), 3) AS double) AS s, cast(round(cast(cast(duration * (strip + 1) / n AS varchar) AS decimal(32, 18)), 3) AS double) AS e FROM (SELECT *, unnest(range(n)) AS strip FROM n))
SELECT ws, strip, s, e, cells, [cast(round(cast(cast(s + (k + 0.5e0) * (e - s) / cells AS varchar) AS decimal(32, 18)), 3) AS double) for k in range(cells)] AS mids FROM w""")
def strip_plan(v):
    """Halves are rounded up as decimals, which the SQL spells out."""
    d = v("orders").select(F.col("o_orderkey").alias("ws"), (F.floor("o_totalprice") / 64).alias("duration"))
    return summary.strip_plan(d)


@book.add("""WITH d AS (SELECT o_orderkey AS ws, floor(o_totalprice) / 65536e0 AS duration FROM orders), x AS (SELECT ws, greatest(duration - 0.2, 0) AS hi, greatest(duration - 2.5, 0) AS lo FROM d)
SELECT DISTINCT ws, round(lo + (greatest(hi, lo) - lo) * k / 4, 3) AS t FROM x, range(5) r(k)""")
def tail_candidates(v):
    return summary.tail_candidates(v("orders").select(F.col("o_orderkey").alias("ws"), (F.floor("o_totalprice") / 65536.0).alias("duration")))


@book.add("""WITH m AS (SELECT ws, t, CASE WHEN ws % 11 <> 0 AND idx % 4 <> 1 THEN score END AS ssim FROM v_scene), p AS (SELECT *, lag(ssim) OVER (PARTITION BY ws ORDER BY t) AS b FROM m)
SELECT ws, arg_max(t, ROW(greatest(coalesce(ssim, -1), coalesce(b, -1)), t)) AS t FROM p WHERE ssim IS NOT NULL OR b IS NOT NULL GROUP BY ws""")
def tail_stability(v):
    """Some pairs could not be measured, and of some videos none."""
    ssim = F.when((F.col("ws") % 11 != 0) & (F.col("idx") % 4 != 1), F.col("score"))
    return summary.tail_stability(v("v_scene").select("ws", "t", ssim.alias("ssim")))


#: Timelines of documents with a line each; the limit is met by some languages' worth of lines, so one half folds and the other does not.
@book.add("""WITH r AS (SELECT doc_id % 2 = 0 AS half, source AS grp, concat('v', doc_id) AS name, concat('v', doc_id, ' ', length(text)) AS line, doc_id % 5 = 0 AS pending FROM documents), t AS (SELECT half, sum(strlen(line)) AS n FROM r WHERE NOT pending GROUP BY half),
x AS (SELECT r.*, CASE WHEN r.half THEN true ELSE false END AS folded FROM r)
SELECT 'video' AS kind, grp, name, line, folded FROM x WHERE NOT pending AND NOT folded UNION ALL SELECT 'group', grp, grp, concat_ws(' ', grp, count(*)), true FROM x WHERE NOT pending AND folded GROUP BY grp UNION ALL SELECT 'pending', grp, name, NULL, folded FROM x WHERE pending""")
def index_rows(v):
    """The index of one half of the documents under a small limit, and of the other under a large one."""
    rows = v("documents").select("doc_id", F.col("source").alias("grp"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("name"), F.length("text").cast("string").alias("n"))
    rows = rows.select("doc_id", "grp", "name", F.concat("name", F.lit(" "), "n").alias("line"), (F.col("doc_id") % 5 == 0).alias("pending"))
    return summary.index_rows(rows.filter("doc_id % 2 = 0"), 1).unionByName(summary.index_rows(rows.filter("doc_id % 2 = 1"), 1 << 40))


@book.add("SELECT ws, array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT label), list_sort(list(DISTINCT concat(label, '-x')))[1:6])))[1:10], ',') AS words FROM v_hits GROUP BY ws")
def keywords(v):
    sets = v("v_hits").groupBy("ws").agg(F.collect_set("label").alias("tags"), F.array_sort(F.collect_set(F.concat("label", F.lit("-x")))).alias("labels"))
    return sets.select("ws", F.array_join(summary.keywords("tags", "labels"), ",").alias("words"))


# sequences: each ledger line repeats one of a timeline's cuts in a new state

SEQ = """sl AS (SELECT ws, line_no, concat(CASE WHEN line_no % 17 = 0 THEN 'sq-' ELSE 'seq-' END, lpad(cast(event_id % 9 AS varchar), 3, '0')) AS seq_id, CASE WHEN event_id % 19 = 0 THEN ' ' ELSE 'intent' END AS intent,
  CASE event_id % 4 WHEN 0 THEN 'assembled' WHEN 1 THEN 'proposed' WHEN 2 THEN 'approved' ELSE 'assembled' END AS status, s, CASE WHEN event_id % 23 = 0 THEN s ELSE s + 5 END AS e, duration, event_id, cp_id FROM v_cp_log),
sr AS (SELECT *, CASE WHEN NOT regexp_matches(seq_id, '^seq-[0-9]{3,}$') THEN 'id' WHEN trim(intent) = '' THEN 'intent' WHEN NOT (s >= 0 AND s < e AND e <= duration) THEN 'span' WHEN event_id % 29 = 0 THEN 'order' WHEN event_id % 31 = 0 THEN 'grounding' END AS reason FROM sl),
rk AS (SELECT *, CASE status WHEN 'assembled' THEN 0 WHEN 'proposed' THEN 1 ELSE 2 END AS rk FROM sr WHERE reason IS NULL),
tp AS (SELECT *, max(rk) OVER (PARTITION BY ws, seq_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tp FROM rk)"""


def lines(v):
    n = F.col("event_id")
    log = v("v_cp_log")
    end = F.when(n % 23 == 0, F.col("s")).otherwise(F.col("s") + 5)
    ids = F.when(n % 31 == 0, F.array().cast("array<string>")).otherwise(F.array("cp_id"))
    cut = lambda order: F.struct(F.col("s").alias("s"), end.alias("e"), order.cast("long").alias("ord"), ids.alias("cp_ids"), F.array().cast("array<string>").alias("signals"))
    second = F.when(n % 29 == 0, F.lit(1)).otherwise(F.lit(None))
    return log.select(
        "ws", "line_no", F.concat(F.when(F.col("line_no") % 17 == 0, "sq-").otherwise("seq-"), F.lpad((n % 9).cast("string"), 3, "0")).alias("seq_id"), F.when(n % 19 == 0, " ").otherwise("intent").alias("intent"),
        F.element_at(F.array(F.lit("assembled"), F.lit("proposed"), F.lit("approved"), F.lit("assembled")), (n % 4 + 1).cast("int")).alias("status"), F.array(cut(F.lit(1)), cut(second)).alias("cuts"), "duration", (n % 37 == 0).alias("legacy"),
    )


@book.add(f"WITH {SEQ} SELECT ws, line_no, seq_id, reason FROM sr")
def validate_sequences(v):
    return lines(v).select("ws", "line_no", "seq_id", sequences.reject_reason().alias("reason"))


@book.add(f"WITH {SEQ} SELECT ws, seq_id, line_no, status FROM (SELECT *, row_number() OVER (PARTITION BY ws, seq_id ORDER BY line_no DESC) AS r FROM tp WHERE tp IS NULL OR rk >= tp) WHERE r = 1")
def latest_sequences(v):
    return sequences.latest(lines(v)).select("ws", "seq_id", "line_no", "status")


#: What a line is by today's rules and by those of the older form; lines past assembled need settled claims that cover their cut, unless pinned.
MIXED = f"""{REPLAY}, {SEQ}, sup AS (SELECT ws, cp_id, s, e, status <> 'hypothesized' AND event_id % 5 <> 0 AS good FROM latest),
mx AS (SELECT l.*, CASE l.status WHEN 'assembled' THEN 0 WHEN 'proposed' THEN 1 ELSE 2 END AS rk, l.event_id % 37 < 9 AS legacy, l.event_id % 31 = 0 AS bare,
    regexp_matches(seq_id, '^seq-[0-9]{{3,}}$') AND trim(intent) <> '' AND l.event_id % 29 <> 0 AND l.event_id % 31 <> 0 AND l.s < l.e AS fine, l.e <= duration AS inside, l.e <= duration + 0.5 AS near,
    c.cp_id IS NOT NULL OR l.event_id % 31 = 0 AS known, l.status = 'assembled' OR l.event_id % 4 = 1 AND l.event_id % 8 = 1 OR coalesce(c.good AND greatest(l.s, c.s) < least(l.e, c.e)
      AND c.s - l.s <= CASE WHEN c.s > l.s THEN least(2, 0.1 * (l.e - l.s)) ELSE 1e9 END AND l.e - c.e <= CASE WHEN c.e < l.e THEN least(2, 0.1 * (l.e - l.s)) ELSE 1e9 END, false) AS sound
  FROM sl l LEFT JOIN sup c ON c.ws = l.ws AND c.cp_id = l.cp_id),
mo AS MATERIALIZED (SELECT ws, seq_id, line_no, status, rk, legacy, inside AS strict, row_number() OVER (PARTITION BY ws, seq_id ORDER BY line_no) AS i FROM mx WHERE fine AND near AND known AND sound),
fo AS (SELECT DISTINCT ws, seq_id, cast(0 AS bigint) AS i, cast(NULL AS bigint) AS line_no, cast(NULL AS varchar) AS status, -1 AS rk, true AS legacy FROM mo UNION ALL
  SELECT ws, seq_id, i, CASE WHEN ok THEN nl ELSE line_no END, CASE WHEN ok THEN ns ELSE status END, CASE WHEN ok THEN nr ELSE rk END, CASE WHEN ok THEN ng ELSE legacy END
  FROM (SELECT fo.ws, fo.seq_id, mo.i, fo.line_no, fo.status, fo.rk, fo.legacy, mo.line_no AS nl, mo.status AS ns, mo.rk AS nr, mo.legacy AS ng, (mo.legacy AND fo.legacy) OR (mo.strict AND mo.rk >= fo.rk) AS ok FROM fo JOIN mo ON mo.ws = fo.ws AND mo.seq_id = fo.seq_id AND mo.i = fo.i + 1)),
mixed AS (SELECT ws, seq_id, line_no, status FROM (SELECT * FROM fo QUALIFY row_number() OVER (PARTITION BY ws, seq_id ORDER BY i DESC) = 1) WHERE line_no IS NOT NULL)"""


def mixed_lines(v) -> tuple[DataFrame, DataFrame]:
    """Lines of both forms, some of them pinned, and the claims as they stand."""
    n = F.col("line_id")
    log = lines(v).join(v("v_cp_log").select("ws", "line_no", F.col("event_id").alias("line_id")), ["ws", "line_no"])
    pins = F.when((n % 4 == 1) & (n % 8 == 1), F.create_map(F.lit("cp"), F.lit("hash")))
    held = claims(v).withColumn("supported", F.col("event_id") % 5 != 0)
    return log.withColumns({"legacy": n % 37 < 9, "pins": pins}), held


def mixed_rows(v) -> DataFrame:
    return sequences.replay_rows(*mixed_lines(v))


@book.add(f"WITH RECURSIVE {MIXED} SELECT ws, seq_id, line_no, status FROM mixed")
def latest_sequences_mixed(v):
    """Lines of the older form may go back; unpinned ones past 'assembled' are judged by the claims of today."""
    return sequences.latest_mixed(*mixed_lines(v))


@book.add(f"WITH {REPLAY}, {SEQ} SELECT DISTINCT sr.ws, sr.line_no, sr.seq_id, sr.cp_id FROM sr WHERE event_id % 31 <> 0 AND (ws, cp_id) NOT IN (SELECT (ws, cp_id) FROM latest)")
def unknown_claims(v):
    return sequences.unknown_claims(lines(v), claims(v))


@book.add("""WITH n AS (SELECT s.ws, sum(e - s) AS spoken, count(*) AS segments, count(DISTINCT trim(text)) / count(*) AS uniq, avg(CASE WHEN contains(text, 'the') OR contains(text, 'ing') THEN 1e0 ELSE 0e0 END) AS hit FROM v_seg s GROUP BY ws), t AS (SELECT ws, sum(e - s) AS speech FROM v_turns GROUP BY ws)
SELECT n.ws, round(spoken / speech, 3) AS coverage, speech >= 60 AND spoken / speech < 0.5 AS collapsed, segments >= 5 AND hit >= 0.5 AND uniq <= 0.3 AS contaminated FROM n JOIN t USING (ws)""")
def transcript_state(v):
    """Coverage, collapse and contamination of each transcript."""
    seg = v("v_seg")
    a = transcript.transcript_coverage(seg, v("v_turns")).select("ws", "coverage", "collapsed")
    return a.join(transcript.hotword_contamination(seg, ["the", "ing"]).select("ws", "contaminated"), "ws")
