"""Queries of rows for people and other tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..operators import edits, knowledge, projections, search, summary
from ..sources.tables import saved
from .base import Book
from .edit_queries import claims
from .text_queries import WORDS, terms
from .timeline_queries import LEVELS, REPLAY, grounded
from .summary_queries import TOLD, told

book = Book()


def every_screen(v):
    """A sign for each turn."""
    return v("v_seg").select("ws", "pos", "s", (F.col("s") + 2).alias("e"), F.concat(F.lit("sign "), "role").alias("text"))


def all_docs(v, signs):
    return projections.search_docs(v("v_seg"), claims(v).withColumn("text", F.col("hypothesis")), signs)


WINDOWS = """lw AS (SELECT *, lead(s, 1) OVER w AS s1, lead(e, 1) OVER w AS e1, lead(text, 1) OVER w AS t1, lead(s, 2) OVER w AS s2, lead(e, 2) OVER w AS e2, lead(text, 2) OVER w AS t2 FROM v_seg WINDOW w AS (PARTITION BY ws ORDER BY pos)),
wn AS (SELECT ws, pos, s, CASE WHEN s2 - e1 <= 5 THEN e2 ELSE e1 END AS e, CASE WHEN s2 - e1 <= 5 THEN concat_ws(' ', text, t1, t2) ELSE concat_ws(' ', text, t1) END AS text FROM lw WHERE s1 - e <= 5)"""


@book.add(f"""WITH {REPLAY}, {WINDOWS} SELECT family, source, count(*) AS docs, sum(length(text)) AS chars FROM (SELECT 'transcript' AS family, 'transcript' AS source, text FROM v_seg UNION ALL SELECT 'transcript', 'window', text FROM wn
UNION ALL SELECT 'understanding', 'checkpoint', hypothesis FROM latest UNION ALL SELECT 'screen', 'ocr', concat('sign ', role) FROM v_seg) GROUP BY ALL""", long="chars")
def search_docs(v):
    return all_docs(v, every_screen(v)).groupBy("family", "source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


#: Each document stands twice: for queries of one word, which search no windows, and for the others.
EVERYWHERE = f"""{REPLAY}, l3 AS (SELECT *, lead(s, 1) OVER w AS s1, lead(e, 1) OVER w AS e1, lead(text, 1) OVER w AS t1, lead(s, 2) OVER w AS s2, lead(e, 2) OVER w AS e2, lead(text, 2) OVER w AS t2 FROM v_seg WINDOW w AS (PARTITION BY ws ORDER BY pos)),
a0 AS (SELECT 'transcript' AS family, concat('t-', ws, '-', pos) AS doc, ws, 'transcript' AS source, s, e, text, CAST([] AS STRUCT(s DOUBLE, e DOUBLE, text VARCHAR)[]) AS members FROM v_seg UNION ALL
  SELECT 'transcript', concat('w-', ws, '-', pos), ws, 'window', s, CASE WHEN s2 - e1 <= 5 THEN e2 ELSE e1 END, CASE WHEN s2 - e1 <= 5 THEN concat_ws(' ', text, t1, t2) ELSE concat_ws(' ', text, t1) END,
    CASE WHEN s2 - e1 <= 5 THEN [{{'s': s, 'e': e, 'text': text}}, {{'s': s1, 'e': e1, 'text': t1}}, {{'s': s2, 'e': e2, 'text': t2}}] ELSE [{{'s': s, 'e': e, 'text': text}}, {{'s': s1, 'e': e1, 'text': t1}}] END FROM l3 WHERE s1 - e <= 5 UNION ALL
  SELECT 'understanding', concat('c-', ws, '-', cp_id), ws, 'checkpoint', s, e, hypothesis, [] FROM latest UNION ALL SELECT 'screen', concat('o-', ws, '-', s), ws, 'ocr', s, s + 2, concat('sign ', role), [] FROM v_seg),
d AS (SELECT concat(family, '/', n) AS family, doc, text, lower(strip_accents(text)) AS folded FROM a0, range(1, 3) r(n) WHERE n = 2 OR len(members) = 0),
{WORDS[WORDS.index("ln AS (") :]},
kq AS (SELECT query, sum(times) AS k, list({{'term': term, 'times': times}}) AS ts FROM q GROUP BY query),
al AS (SELECT a.*, ts FROM (SELECT * FROM bm UNION ALL SELECT * FROM sb) a JOIN kq USING (query) WHERE suffix(family, CASE WHEN k = 1 THEN '/1' ELSE '/2' END)),
nw AS (SELECT query, family, al.place, al.doc, ws, CASE WHEN len(members) > 0 THEN 'transcript' ELSE source END AS source, CASE WHEN len(members) > 0 THEN members[list_position(n, list_max(n))].s ELSE s END AS s, CASE WHEN len(members) > 0 THEN members[list_position(n, list_max(n))].e ELSE e END AS e
  FROM (SELECT al.*, a0.ws, a0.source, a0.s, a0.e, members, [list_sum([t.times * (length(m.text) - length(replace(m.text, t.term, ''))) / length(t.term) FOR t IN ts]) FOR m IN members] AS n FROM al JOIN a0 USING (doc)) al),
fi AS (SELECT *, row_number() OVER (PARTITION BY query, family ORDER BY place, doc) AS own FROM (SELECT *, row_number() OVER (PARTITION BY query, ws, source, s, e ORDER BY place, doc) AS r FROM nw) WHERE r = 1),
fu AS (SELECT query, ws, source, s, e, round(sum(1 / (60 + own)), 4) AS score FROM fi GROUP BY ALL)"""


@book.add(f"WITH {EVERYWHERE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ws, source, s, e) AS place FROM fu) WHERE place <= 10")
def search_with_windows(v):
    """Corpus search over all families, window hits narrowed to the member that says most of the query; one-word queries search no windows."""
    v.keep("v_event")
    found = all_docs(v, every_screen(v)).withColumn("folded", tx.fold(F.col("text")))
    d = saved(found.repartition(found.sparkSession.sparkContext.defaultParallelism * 2), "docs")
    return search.search(d, terms(v), 10)


@book.add(f"WITH {REPLAY}, w AS (SELECT * FROM (VALUES ('cp-004', 1), ('cp-001', 2), ('cp-099', 3)) t(cp_id, place)) SELECT l.ws, l.cp_id, w.place, l.s FROM latest l JOIN w USING (cp_id)", long="place")
def select_claims(v):
    return projections.select_claims(claims(v), ["cp-004", "cp-001", "cp-004", "cp-099"])[0].select("ws", "cp_id", "place", "s")


#: Transcripts by part: its brand or 'alpha beta' as glossary, its type as prior, put together in six ways.
MADE = """md AS (SELECT p_partkey AS ws, CASE WHEN p_size % 7 = 0 THEN 'captions' ELSE 'whisper' END AS source, p_partkey % 6 <> 5 AS stamped, CASE WHEN p_size % 3 = 0 THEN 'alpha beta' ELSE p_brand END AS g, p_type AS prior, p_partkey % 6 AS k FROM {part}),
mv AS (SELECT ws, source, stamped, prior, CASE k WHEN 0 THEN concat(g, ' ', prior) WHEN 1 THEN concat(prior, ' ', g) WHEN 2 THEN g WHEN 4 THEN prior ELSE '' END AS hotwords, CASE k WHEN 3 THEN concat(g, ' ', prior) END AS rejected FROM md)"""


@book.add(f"""WITH {MADE.format(part="part")}, gl AS (SELECT *, CASE WHEN hotwords <> '' THEN hotwords ELSE rejected END AS used FROM mv),
cut AS (SELECT *, CASE WHEN used = prior THEN NULL WHEN suffix(used, concat(' ', prior)) THEN used[1 : length(used) - length(prior) - 1] ELSE used END AS was FROM gl)
SELECT ws, CASE WHEN source <> 'whisper' THEN NULL WHEN NOT stamped THEN 'legacy' WHEN was IS NOT DISTINCT FROM 'alpha beta' THEN 'same' ELSE 'changed' END AS drift FROM cut""")
def hotword_drift(v):
    made = v("part").sparkSession.sql(f"WITH {MADE} SELECT * FROM mv", part=v("part"))
    return projections.hotword_drift(made, "alpha beta")


@book.add("""SELECT page AS src, concat(target, '#x') AS target, CASE WHEN length(target) % 2 = 0 THEN concat('/new', target, '#x') ELSE concat(target, '#x') END AS new FROM v_links""")
def rewrite_links(v):
    links = v("v_links").select(F.col("page").alias("src"), F.concat("target", F.lit("#x")).alias("target"))
    moves = v("v_links").filter("length(target) % 2 = 0").select(F.col("target").alias("old"), F.concat(F.lit("/new"), "target").alias("new"))
    return projections.rewrite_links(links, knowledge.rewrite_map(moves))


@book.add("SELECT ws, label, t, conf, place FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY conf DESC, t, label) AS place FROM v_hits) WHERE place <= 3")
def top_events(v):
    return projections.top_per_video(v("v_hits"), [F.desc("conf"), F.col("t"), F.col("label")], 3)


@book.add("""WITH x AS (SELECT ws % 7 AS grp, label, concat(ws, '-', t) AS moment FROM v_hits) SELECT grp, count(DISTINCT label) AS label, count(DISTINCT moment) AS moment, true AS label_near, true AS moment_near FROM x GROUP BY grp""")
def distinct_estimates(v):
    """Sketches per video, of two halves of the rows, united by group; estimates lie within 4 % of the exact counts."""
    rows = v("v_hits").select("ws", "label", F.concat_ws("-", "ws", F.col("t").cast("string")).alias("moment"), (F.col("conf") < 0.5).alias("half"))
    columns, grp = ["label", "moment"], (F.col("ws") % 7).alias("grp")
    parts = [saved(projections.distinct_sketches(rows.filter(F.col("half") == half), columns), "sketches") for half in (True, False)]
    guess = projections.united_counts(parts[0].unionByName(parts[1]).withColumn("grp", grp), columns, ["grp"]).toDF("grp", "label_guess", "moment_guess")
    exact = rows.groupBy(grp).agg(*[F.count_distinct(c).alias(c) for c in columns])
    near = lambda c: (F.abs(F.col(f"{c}_guess") - F.col(c)) <= 0.04 * F.col(c)).alias(f"{c}_near")
    return exact.join(guess, "grp").select("grp", *columns, *map(near, columns))


@book.add("SELECT ws, count(DISTINCT label) AS label, count(DISTINCT conf) AS conf FROM v_hits GROUP BY ws")
def distinct_counts(v):
    return projections.distinct_counts(v("v_hits"), ["label", "conf"])


@book.add("SELECT ws, idx FROM (SELECT ws, idx, 100 - score * 100 AS low, 100 + db AS high FROM v_scene JOIN v_loud USING (ws, idx) WHERE db IS NOT NULL) WHERE high - low >= 16")
def blank_frames(v):
    both = v("v_scene").select("ws", "idx", (100 - F.col("score") * 100).alias("low")).join(v("v_loud").filter("db IS NOT NULL").select("ws", "idx", (100 + F.col("db")).alias("high")), ["ws", "idx"])
    return projections.blank_frames(both).select("ws", "idx")


@book.add(f"WITH {TOLD}, {LEVELS} SELECT td.ws, td.cp_id, td.s, td.e, arc, td.status, hypothesis AS text, sp AS speakers, confidence, lev.level, coalesce(n.n, 0) AS evidence FROM td JOIN lev ON lev.ws = td.ws AND lev.cp_id = td.cp_id LEFT JOIN (SELECT ws, cp_id, count(*) AS n FROM vis GROUP BY ALL) n ON n.ws = td.ws AND n.cp_id = td.cp_id")
def scene_log(v):
    levels, visual = grounded(v)
    return projections.scene_log(told(v), levels, visual)


STAMP = "concat(lpad(cast({0} // 60 AS varchar), 2, '0'), ':', lpad(cast({0} % 60 AS varchar), 2, '0'), '.000')"


@book.add(f"""WITH {REPLAY}, d AS (SELECT ws, seq_id, string_agg(DISTINCT cp_id, ', ' ORDER BY cp_id) AS drifted FROM v_cuts c WHERE (ws, cp_id) NOT IN (SELECT (ws, cp_id) FROM latest) GROUP BY ALL),
n AS (SELECT ws, seq_id, count(*) AS cuts, sum(e - s) AS length, string_agg(concat(CASE WHEN ord % 3 = 0 THEN '-' ELSE concat({STAMP.format("cast(s AS bigint)")}, '-', {STAMP.format("cast(e AS bigint)")}) END, ' no ', cp_id), '; ' ORDER BY ord) AS rejected FROM v_cuts GROUP BY ALL)
SELECT ws, seq_id, 'an intent' AS intent, 'proposed' AS status, concat('goal: two lines · tone: as ', seq_id) AS brief, cuts, length, rejected, coalesce(drifted, '') AS drifted FROM n LEFT JOIN d USING (ws, seq_id)""")
def edits_log(v):
    """The cuts of a sequence are its rejected alternatives too, each third without its span."""
    now = claims(v).select("ws", "cp_id", edits.revision_hash("confidence", "cp_id", "e", "s", "status").alias("revision"))
    cited = v("v_cuts").select("ws", "seq_id", "ord", "cp_id")
    pins = cited.select("ws", "seq_id", "cp_id").distinct().join(now, ["ws", "cp_id"], "left").fillna("gone", ["revision"])
    each = v("v_cuts").groupBy("ws", "seq_id").agg(F.array_sort(F.collect_list(F.struct("ord", "s", "e", "cp_id"))).alias("cuts"))
    other = F.transform("cuts", lambda c: F.struct(F.when(c["ord"] % 3 != 0, c["s"]).alias("s"), c["e"].alias("e"), F.concat(F.lit("no\n "), c["cp_id"]).alias("reason")))
    brief = F.create_map(F.lit("tone"), F.concat(F.lit("as "), "seq_id"), F.lit("goal"), F.lit("two\nlines"))
    rows = each.withColumns({"intent": F.lit("an intent"), "status": F.lit("proposed"), "brief": brief, "alternatives": other})
    return projections.edits_log(rows, edits.pin_states(cited, pins, now))


@book.add("""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS ws FROM pages UNION ALL SELECT page_id, replace(regexp_replace(url, '^[a-z]+://', ''), '/', CASE WHEN page_id % 5 = 0 THEN '-' ELSE '/x/' END) FROM pages UNION ALL SELECT p_partkey, CASE WHEN p_partkey = 0 THEN 'index' ELSE concat('part/', cast(p_partkey AS varchar)) END FROM part),
n AS (SELECT *, CASE WHEN ws = 'index' THEN 'index-ws' ELSE replace(ws, '/', '-') END AS name FROM p)
SELECT ws, name, concat('["page ', cast(page_id AS varchar), '","other"]') AS aliases, CASE WHEN page_id % 3 = 0 THEN '—' ELSE 'a head' END AS head, concat('silent · 01:30.000 · readiness converged · claims ', cast(page_id AS varchar)) AS line, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN 'collision' END AS reason FROM n""")
def routing_stubs(v):
    """Addresses of pages and two other spellings of them as paths, some of which give one name."""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    pages = v("pages").select("page_id", path.alias("ws"))
    other = pages.select("page_id", F.replace("ws", F.lit("/"), F.when(F.col("page_id") % 5 == 0, "-").otherwise("/x/")).alias("ws"))
    parts = v("part").select(F.col("p_partkey").alias("page_id"), F.when(F.col("p_partkey") == 0, "index").otherwise(F.concat(F.lit("part/"), F.col("p_partkey").cast("string"))).alias("ws"))
    title = F.concat(F.lit(" page "), F.col("page_id").cast("string"))
    rows = pages.unionByName(other).unionByName(parts).select(
        "ws", title.alias("title"), F.array(F.lit("other "), F.lit(" "), title).alias("labels"), F.when(F.col("page_id") % 3 == 0, " ").otherwise("a head").alias("head"),
        F.lit("silent").alias("mode"), F.lit("converged").alias("advice"), F.col("page_id").alias("claims"), F.lit(90.0).alias("duration"),
    )
    return projections.routing_stubs(rows)


@book.add("SELECT lower(split_part(p_name, ' ', -1)) AS name, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def name_collisions(v):
    return projections.name_collisions(v("part").select(F.replace("p_name", F.lit(" "), F.lit("/")).alias("ws")))


@book.add("SELECT ws, path, CASE WHEN ws % 5 = 0 THEN 'outside' WHEN path LIKE '%.jpg' AND starts_with(path, 'frames/') THEN NULL WHEN starts_with(path, 'frames/') THEN 'suffix' ELSE 'folder' END AS reason FROM (SELECT ws, CASE WHEN ws % 5 = 0 THEN concat('frames/../', path) ELSE path END AS path FROM v_files)")
def normalize_images(v):
    path = F.when(F.col("ws") % 5 == 0, F.concat(F.lit("./frames/../"), "path")).otherwise(F.col("path"))
    return projections.normalize_images(v("v_files").select("ws", path.alias("path"))).select("ws", "path", "reason")


@book.add("SELECT subj, list_sort(list(DISTINCT pred)) AS labels FROM v_edge WHERE subj % 3 <> 0 GROUP BY subj HAVING count(DISTINCT pred) >= 2")
def relation_candidates(v):
    each = v("v_edge").groupBy("subj").agg(F.array_sort(F.collect_set("pred")).alias("labels"))
    triple = F.when(F.col("subj") % 3 == 0, F.array(F.struct(F.lit("a").alias("s"), F.lit("b").alias("p"), F.lit("c").alias("o")))).otherwise(F.array(F.struct(F.lit("a").alias("s"), F.lit("").alias("p"), F.lit("c").alias("o"))))
    found = knowledge.relation_candidates(each.select(F.col("subj").alias("ws"), F.lit("cp").alias("cp_id"), triple.alias("relations"), "labels"))
    return found.select(F.col("ws").alias("subj"), "labels")


@book.add("""SELECT o_orderkey, greatest(0, least(cast(floor(o_custkey % 1900 + 50 - 607 / 2.0) AS bigint), 1920 - 607)) AS x, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'to be checked' ELSE 'P' END AS label, replace(o_orderpriority, '-', ': ') AS words,
concat('note ', o_orderstatus, chr(10), 'grounding: checkpoint:cp@abcdefabcdef, signal:', o_orderpriority) AS note FROM orders""")
def label_functions(v):
    status = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "hypothesized").otherwise(F.col("o_orderstatus"))
    cited = F.array(F.struct(F.lit("cp").alias("id"), F.lit("abcdefabcdef0123").alias("hash")))
    note = lb.handoff_note(F.concat(F.lit("note "), "o_orderstatus", F.lit("\nmore")), cited, F.array("o_orderpriority"))
    x = lb.roi_center_x(F.col("o_custkey") % 1900, F.lit(100), F.lit(1920), F.lit(1080))
    return v("orders").select("o_orderkey", x.alias("x"), lb.status_label(status).alias("label"), lb.humanize(F.col("o_orderpriority"), [("-", ": ")]).alias("words"), note.alias("note"))


@book.add("SELECT [p_name, p_type, p_brand] AS aliases, p_partkey FROM part")
def alias_list(v):
    return v("part").select("p_partkey", lb.alias_list(F.col("p_name"), F.array("p_type", F.concat(F.lit(" "), "p_name"), F.lit(""), "p_brand")).alias("aliases"))


@book.add("SELECT o_orderkey AS ws, i * 10e0 AS start, i * 10e0 + 10 AS \"end\", concat('part ', cast(i AS varchar)) AS title FROM orders, range(3) r(i) WHERE o_custkey % 2 = 0")
def chapter_spans(v):
    chapter = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct((i * 10.0).alias("start"), (i * 10.0 + 10).alias("end"), F.concat(F.lit("part "), i.cast("string")).alias("title")))
    none = F.array().cast("array<struct<start:double,end:double,title:string>>")
    return summary.chapter_spans(v("orders").select(F.col("o_orderkey").alias("ws"), F.when(F.col("o_custkey") % 2 == 0, chapter).otherwise(none).alias("chapters")))
