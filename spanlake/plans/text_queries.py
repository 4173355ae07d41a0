"""Queries of transcripts, search and knowledge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import knowledge, search, transcript
from ..sources.tables import folder, saved
from .base import Book

book = Book()

@book.add("""SELECT ws, pos, s, CASE WHEN s2 - e1 <= 5 THEN e2 ELSE e1 END AS e, CASE WHEN s2 - e1 <= 5 THEN concat_ws(' ', text, t1, t2) ELSE concat_ws(' ', text, t1) END AS text,
  CASE WHEN s2 - e1 <= 5 THEN 3 ELSE 2 END AS members FROM (SELECT *, lead(s, 1) OVER w AS s1, lead(e, 1) OVER w AS e1, lead(text, 1) OVER w AS t1, lead(s, 2) OVER w AS s2, lead(e, 2) OVER w AS e2, lead(text, 2) OVER w AS t2
  FROM v_seg WINDOW w AS (PARTITION BY ws ORDER BY pos)) WHERE s1 - e <= 5""", long="members")
def transcript_windows(v):
    return transcript.windows(v("v_seg")).withColumn("members", F.size("members"))


@book.add("SELECT ws, count(*) AS segments, count(*) FILTER (CASE WHEN conf IS NOT NULL THEN conf < 0.6 ELSE logprob < -1 OR no_speech_prob > 0.5 END) AS uncertain FROM v_seg GROUP BY ws")
def uncertain_segments(v):
    return v("v_seg").groupBy("ws").agg(F.count("*").alias("segments"), F.count_if(transcript.uncertain()).alias("uncertain"))


@book.add("""SELECT g.ws, g.pos, g.s, g.e, x.speaker FROM v_seg g LEFT JOIN (SELECT * FROM (SELECT g.ws, g.pos, t.speaker, row_number() OVER (PARTITION BY g.ws, g.pos ORDER BY least(g.e, t.e) - greatest(g.s, t.s) DESC, t.pos) AS r
  FROM v_seg g JOIN v_turns t ON t.ws = g.ws AND greatest(g.s, t.s) < least(g.e, t.e)) WHERE r = 1) x ON x.ws = g.ws AND x.pos = g.pos""")
def assign_speakers(v):
    return transcript.assign_speakers(v("v_seg").select("ws", "pos", "s", "e"), v("v_turns"))


ASSIGNED = "asg AS (SELECT g.ws, g.pos, w.pos * 1000 + w.k AS k, w.s AS word_s, w.e AS word_e, w.word, w.p FROM v_seg g JOIN v_words w ON w.ws = g.ws AND w.s >= g.s - 0.01 AND w.s < g.e + 0.01)"


def assigned(v) -> DataFrame:
    return transcript.assign_words(v("v_seg"), v("v_words").withColumn("k", F.col("pos") * 1000 + F.col("k")))


@book.add(f"WITH {ASSIGNED} SELECT * FROM asg")
def assign_words(v):
    return assigned(v)


@book.add(f"""WITH {ASSIGNED}, n AS (SELECT *, CASE WHEN word_s - lag(word_e) OVER (PARTITION BY ws, pos ORDER BY word_s, k) > 0.05 THEN 1 ELSE 0 END AS nw FROM asg), r AS (SELECT *, sum(nw) OVER (PARTITION BY ws, pos ORDER BY word_s, k ROWS UNBOUNDED PRECEDING) AS part FROM n)
SELECT ws, pos, part, min(word_s) AS s, max(word_e) AS e, string_agg(word, ' ' ORDER BY word_s, k) AS text, round(avg(p), 3) AS conf FROM r GROUP BY ws, pos, part""", long="part")
def split_on_gaps(v):
    """Cut at pauses over 0.05 s, which these words have."""
    return transcript.split_on_gaps(assigned(v), 0.05)


@book.add(f"""WITH {ASSIGNED}, n AS (SELECT *, CASE WHEN word_s - lag(word_e) OVER (PARTITION BY ws, pos ORDER BY word_s, k) > 0.05 THEN 1 ELSE 0 END AS nw FROM asg), r AS (SELECT *, sum(nw) OVER (PARTITION BY ws, pos ORDER BY word_s, k ROWS UNBOUNDED PRECEDING) AS part FROM n),
pt AS (SELECT ws, pos, part, round(min(word_s), 3) AS s, round(max_by(word_e, ROW(word_s, k)), 3) AS e, trim(string_agg(word, ' ' ORDER BY word_s, k)) AS text, round(avg(p), 3) AS conf FROM r GROUP BY ws, pos, part),
x AS (SELECT *, count(*) OVER (PARTITION BY ws, pos) AS parts FROM pt),
al AS (SELECT ws, pos, part, s, e, text, conf FROM x WHERE parts > 1 UNION ALL SELECT ws, pos, 0, s, e, text, conf FROM v_seg g WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.ws = g.ws AND x.pos = g.pos AND parts > 1))
SELECT ws, row_number() OVER (PARTITION BY ws ORDER BY pos, part) - 1 AS id, s, e, text, conf FROM al""")
def split_segments(v):
    """Segments cut at pauses, beside those that stay whole, numbered anew."""
    words = v("v_words").withColumn("k", F.col("pos") * 1000 + F.col("k"))
    return transcript.split_segments(v("v_seg"), words, 0.05, " ")


@book.add("""SELECT ws, row_number() OVER (PARTITION BY ws ORDER BY pos) - 1 AS id, s, e, text, conf FROM (SELECT ws, pos, min(s) AS s, max_by(e, k) AS e, trim(string_agg(word, ' ' ORDER BY k)) AS text, round(avg(p), 3) AS conf FROM v_words GROUP BY ws, pos) WHERE text <> ''""")
def segments_from_words(v):
    return transcript.segments_from_words(v("v_words"))


@book.add("""SELECT b.ws, coalesce(a.n, 0) AS spoken, b.n AS speech, round(coalesce(a.n, 0) / b.n, 3) AS coverage, b.n >= 60 AND coalesce(a.n, 0) / b.n < 0.5 AS collapsed
  FROM (SELECT ws, sum(e - s) AS n FROM v_turns GROUP BY ws) b LEFT JOIN (SELECT ws, sum(e - s) AS n FROM v_seg GROUP BY ws) a USING (ws)""")
def transcript_coverage(v):
    return transcript.transcript_coverage(v("v_seg"), v("v_turns"))


@book.add("""SELECT ws, segments, hit_share, unique_share, segments >= 5 AND hit_share >= 0.5 AND unique_share <= 0.3 AS contaminated FROM
  (SELECT ws, count(*) AS segments, avg(CASE WHEN contains(text, 'the') OR contains(text, 'ing') THEN 1e0 ELSE 0e0 END) AS hit_share, count(DISTINCT trim(text)) / count(*) AS unique_share FROM v_seg GROUP BY ws)""")
def hotword_contamination(v):
    return transcript.hotword_contamination(v("v_seg"), ["the", "ing"])


#: Segments with a compression ratio, and words with low p, made from what the turns have.
FLAGS = r"""t AS (SELECT ws, pos, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM v_seg), c AS (SELECT ws, pos, w, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT ws, pos, max(n) / sum(n) AS top, sum(n) AS words FROM c GROUP BY ws, pos),
m AS (SELECT ws, pos, avg(p / 8) AS mp FROM v_words GROUP BY ws, pos),
fl AS (SELECT g.ws, g.pos, coalesce(words >= 12 AND top >= 0.6, false) AS repetitive, length(text) % 25 / 8 > 2.4 AS compressed, logprob < -1 AS unlikely, coalesce(mp < 0.1, false) AS unsure FROM v_seg g LEFT JOIN r USING (ws, pos) LEFT JOIN m USING (ws, pos) WHERE trim(text) <> '')"""


def pressed(v) -> DataFrame:
    return v("v_seg").withColumn("compression_ratio", F.length("text") % 25 / 8)


def dim_words(v) -> DataFrame:
    return v("v_words").select("ws", "pos", (F.col("p") / 8).alias("p"))


@book.add(f"WITH {FLAGS} SELECT * FROM fl")
def quality_flags(v):
    return transcript.quality_flags(pressed(v), dim_words(v))


@book.add(f"""WITH {FLAGS}, b AS (SELECT ws, count(*) FILTER (repetitive OR compressed OR unlikely OR unsure) AS rejected FROM fl GROUP BY ws),
h AS (SELECT ws, count(*) AS segments, max(e) AS stall, sum(e - s) AS spoken, count(*) >= 5 AND avg(CASE WHEN contains(text, 'the') THEN 1e0 ELSE 0e0 END) >= 0.5 AND count(DISTINCT trim(text)) / count(*) <= 0.3 AS contaminated FROM v_seg GROUP BY ws),
sp AS (SELECT ws, sum(e - s) * 8 AS speech FROM v_turns GROUP BY ws),
hd AS (SELECT t.ws, sum(greatest(0, least(t.s + (t.e - t.s) * 8, stall) - t.s)) AS heard FROM v_turns t JOIN h USING (ws) GROUP BY t.ws),
o AS (SELECT h.ws, segments, coalesce(rejected, 0) AS rejected, speech >= 60 AND spoken / speech < 0.5 AS collapsed, contaminated, heard > 0 AND spoken / heard >= 0.5 AS healthy FROM h LEFT JOIN b USING (ws) JOIN sp USING (ws) JOIN hd USING (ws))
SELECT ws, segments, rejected, collapsed, contaminated, CASE WHEN contaminated OR rejected >= segments / 2 THEN 'full' WHEN NOT collapsed THEN 'keep' WHEN healthy THEN 'tail' ELSE 'full' END AS advice FROM o""")
def transcript_qc(v):
    """Speech of eight times the length, so that some transcripts collapse."""
    speech = v("v_turns").withColumn("e", F.col("s") + (F.col("e") - F.col("s")) * 8)
    return transcript.transcript_qc(pressed(v), dim_words(v), speech, ["the"])


@book.add("""SELECT ws, attempt, spoken FROM (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY spoken DESC, attempt) AS r FROM (SELECT ws, pos % 3 AS attempt, sum(e - s) AS spoken FROM v_seg GROUP BY ALL)) WHERE r = 1""")
def best_transcript(v):
    return transcript.best_transcript(v("v_seg").withColumn("attempt", F.col("pos") % 3))


@book.add("""WITH st AS (SELECT ws, max(s) / 2 AS stall FROM v_seg GROUP BY ws), b AS (SELECT g.ws, s, e, text, 0 AS late, pos FROM v_seg g JOIN st USING (ws) WHERE s < stall UNION ALL SELECT t.ws, s + stall, e + stall, speaker, 1, pos FROM v_turns t JOIN st USING (ws))
SELECT ws, row_number() OVER (PARTITION BY ws ORDER BY late, pos) - 1 AS id, s, e, text FROM b""")
def splice_tail(v):
    seg = v("v_seg")
    tail = v("v_turns").withColumnRenamed("speaker", "text")
    return transcript.splice_tail(seg, tail, seg.groupBy("ws").agg((F.max("s") / 2).alias("stall")))


@book.add("""WITH l AS (SELECT ws, max(e) AS stall, sum(e - s) AS spoken FROM v_seg GROUP BY ws), h AS (SELECT t.ws, stall, spoken, sum(greatest(0, least(t.e, stall) - t.s)) AS heard FROM v_turns t JOIN l ON l.ws = t.ws GROUP BY ALL)
SELECT ws, stall, heard, spoken, CASE WHEN heard > 0 THEN spoken / heard >= 0.5 ELSE false END AS healthy FROM h""")
def prefix_speech(v):
    return transcript.prefix_speech(v("v_turns"), v("v_seg")).select("ws", "stall", "heard", "spoken", "healthy")


def cues(v) -> DataFrame:
    """Rolling captions of whole documents: 6 words at a stride of 3 up to the last word.

    Windows are cut before they are exploded, so no row carries the text.
    """
    words = v("documents").select(F.col("doc_id").alias("ws"), F.split("text", " ").alias("w"))
    starts = F.sequence(F.lit(0), (F.ceil(F.size("w") / 3) - 1).cast("int"))
    each = words.select("ws", F.posexplode(F.transform(starts, lambda k: F.array_join(F.slice("w", 1 + 3 * k, F.lit(6)), " "))).alias("k", "text"))
    return each.select("ws", "k", "text", F.col("k").cast("double").alias("s"), (F.col("k") + 2.0).alias("e"))


@book.add()
def dedupe_rolling_cues(v):
    return transcript.dedupe_rolling(cues(v))


# search: transcript documents by role; a benchmark item is cut into queries of two words, all of its words in turn


def docs(v) -> DataFrame:
    """Folded once and kept as a table of files for all cores, as an archive that many queries search would be."""
    seg = v("v_seg").withColumn("text", tx.nfc("text"))
    name = F.concat(F.col("ws").cast("string"), F.lit("-"), F.col("pos").cast("string"))
    members = F.array().cast("array<struct<s:double,e:double,text:string>>")
    return saved(seg.select(F.col("role").alias("family"), name.alias("doc"), "ws", F.col("role").alias("source"), "s", "e", "text", tx.fold(F.col("text")).alias("folded"), members.alias("members")).repartition(seg.sparkSession.sparkContext.defaultParallelism * 2), "docs")


def pairs_of_words(v) -> DataFrame:
    """(query, w): two words in a row of a benchmark item, the last alone where their number is odd."""
    words = v("benchmark").select("item_id", F.filter(F.split(tx.nfc("text"), r"\s+"), lambda x: x != "").alias("w"))
    each = words.filter("size(w) > 0").select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"), F.lit(2))).alias("k"))
    return each.select(F.concat_ws("-", F.col("item_id").cast("string"), F.col("k").cast("string")).alias("query"), F.slice("w", F.col("k"), F.lit(2)).alias("w"))


def terms(v) -> DataFrame:
    return saved(pairs_of_words(v).select("query", F.explode("w").alias("term")), "terms")


def joined_terms(v) -> DataFrame:
    """Each pair as one term with a hyphen, the second word without its end, so that it matches as a prefix."""
    second = F.substring(F.element_at("w", 2), F.lit(1), F.greatest(F.length(F.element_at("w", 2)) - 1, F.lit(1)))
    return saved(pairs_of_words(v).filter("size(w) = 2").select("query", F.concat(F.element_at("w", 1), F.lit("-"), second).alias("term")), "terms")


SEARCH = r"""
d AS (SELECT role AS family, concat(cast(ws AS varchar), '-', cast(pos AS varchar)) AS doc, ws, role AS source, s, e, nfc_normalize(text) AS text, lower(strip_accents(text)) AS folded FROM v_seg),
ln AS (SELECT family, doc, list_filter(string_split_regex(folded, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w, len(w) AS len FROM d),
tk AS (SELECT family, doc, unnest(w) AS token, unnest(range(len(w))) AS tpos FROM ln),
st AS (SELECT family, count(*) AS nd, avg(len) AS ml FROM ln GROUP BY family),
bw AS (SELECT item_id, list_filter(string_split_regex(nfc_normalize(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
pw AS (SELECT concat(item_id, '-', k) AS query, w[k : k + 1] AS w FROM (SELECT item_id, w, unnest(range(1, len(w) + 1, 2)) AS k FROM bw)),
q AS (SELECT query, term, count(*) AS times FROM ({terms}) GROUP BY ALL),
qp AS (SELECT query, p, array_to_string(p, ' ') AS phrase, sum(times) AS times FROM (SELECT query, times, list_filter(string_split_regex(lower(strip_accents(term)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS p FROM q) WHERE len(p) > 0 GROUP BY ALL),
u AS (SELECT phrase, len(p) AS k, unnest(p) AS unit, unnest(range(len(p))) AS i FROM (SELECT DISTINCT phrase, p FROM qp)),
oc AS (SELECT u.phrase, u.k, family, doc, tpos - i AS start FROM u JOIN tk ON i = k - 1 AND starts_with(token, unit) UNION ALL SELECT u.phrase, u.k, family, doc, tpos - i FROM u JOIN tk ON i < k - 1 AND token = unit),
f AS (SELECT phrase, family, doc, count(*) AS f FROM (SELECT phrase, family, doc, start FROM oc GROUP BY phrase, k, family, doc, start HAVING count(*) = k) GROUP BY ALL),
df AS (SELECT phrase, family, count(*) AS n FROM f GROUP BY ALL),
sc AS (SELECT query, f.family, f.doc, round(sum(times * greatest(ln((nd - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / ml))), 6) AS score, count(*) AS hits
  FROM qp JOIN f USING (phrase) JOIN df USING (phrase, family) JOIN st USING (family) JOIN ln USING (family, doc) GROUP BY query, f.family, f.doc),
bm AS (SELECT query, family, doc, score, place FROM (SELECT sc.*, row_number() OVER (PARTITION BY sc.query, family ORDER BY score DESC, doc) AS place FROM sc JOIN (SELECT query, count(*) AS k FROM qp GROUP BY query) k ON k.query = sc.query AND hits = k.k) WHERE place <= 40),
lf AS (SELECT query, family FROM (SELECT DISTINCT query FROM q), (SELECT DISTINCT family FROM d) EXCEPT SELECT query, family FROM bm),
sb0 AS (SELECT lf.query, d.family, d.doc, sum(times * (length(text) - length(replace(text, term, ''))) / length(term)) AS score FROM lf JOIN d USING (family) JOIN q ON q.query = lf.query GROUP BY ALL HAVING bool_and(contains(text, term))),
sb AS (SELECT query, family, doc, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query, family ORDER BY score DESC, doc) AS place FROM sb0) WHERE place <= 40)"""
WORDS = SEARCH.replace("{terms}", "SELECT query, unnest(w) AS term FROM pw")
HYPHENS = SEARCH.replace("{terms}", "SELECT query, concat(w[1], '-', w[2][1 : greatest(length(w[2]) - 1, 1)]) AS term FROM pw WHERE len(w) = 2")


@book.add(f"WITH {WORDS} SELECT * FROM bm")
def bm25(v):
    return search.bm25(docs(v), terms(v), 40)


@book.add(f"WITH {HYPHENS} SELECT * FROM bm")
def bm25_phrases(v):
    """Terms of two words with a hyphen between: phrases whose last token is a prefix."""
    return search.bm25(docs(v), joined_terms(v), 40)


@book.add(f"WITH {WORDS} SELECT * FROM sb")
def substring_rank(v):
    d, t = docs(v), terms(v)
    return search.substring_rank(d, t, saved(search.bm25(d, t, 40), "ranked"), 40)


#: The fallback of an archive without tokens: all words of a pair, cut at both ends, as parts of words.
@book.add(f"""WITH {SEARCH.replace("{terms}", "SELECT query, x[2 : length(x) - 1] AS term FROM (SELECT query, unnest(w) AS x FROM pw) WHERE length(x) > 3").replace("EXCEPT SELECT query, family FROM bm", "")} SELECT * FROM sb""")
def substring_parts(v):
    """Parts of words, looked up by their rarest run of characters in all families."""
    t = pairs_of_words(v).select("query", F.explode("w").alias("x")).filter("length(x) > 3").select("query", F.expr("substring(x, 2, length(x) - 2)").alias("term"))
    d = docs(v)
    return search.substring_rank(d, saved(t, "terms"), d.select(F.lit("").alias("query"), "family").limit(0), 40)


@book.add(f"""WITH {WORDS}, al AS (SELECT * FROM bm UNION ALL SELECT * FROM sb), fu AS (SELECT query, ws, source, s, e, round(sum(1 / (60 + place)), 4) AS score FROM al JOIN d USING (doc) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ws, source, s, e) AS place FROM fu) WHERE place <= 10""")
def corpus_search(v):
    """Ranked families of all queries, fused by rank."""
    return search.search(docs(v), terms(v), 10)


@book.add(r"""WITH qi AS (SELECT DISTINCT item_id AS query, unnest(list_filter(string_split_regex(lower(strip_accents(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark) SELECT query, ws, pos, n FROM (SELECT *, row_number() OVER (PARTITION BY query, ws ORDER BY n DESC, s, pos) AS r FROM
  (SELECT query, ws, pos, s, count(*) AS n FROM v_seg JOIN qi ON contains(lower(strip_accents(text)), term) AND length(term) >= 2 GROUP BY ALL)) WHERE r <= 3""")
def intent_hits(v):
    """Of each benchmark item, all words: any of them counts."""
    items = v("benchmark").select(F.col("item_id").alias("query"), F.explode(tx.tokens(tx.fold(F.col("text")))).alias("term")).distinct()
    return search.intent_hits(v("v_seg").select("ws", "pos", "s", tx.fold(F.col("text")).alias("folded")), items)


# knowledge: labels of supplier timelines, customer relations, page links


INDEX = "ix AS (SELECT label, count(DISTINCT ws) AS videos, count(*) AS rows FROM v_label GROUP BY label)"


@book.add(f"WITH {INDEX} SELECT * FROM ix")
def entity_index(v):
    return knowledge.entity_index(v("v_label"))


@book.add(f"WITH {INDEX} SELECT DISTINCT ws, label FROM v_label WHERE label IN (SELECT label FROM ix ORDER BY videos DESC, label LIMIT 400)")
def graph_top_entities(v):
    return knowledge.top_entities(knowledge.entity_index(v("v_label")), v("v_label"))


@book.add(f"WITH {INDEX} SELECT least(count(*), 400) AS kept, greatest(count(*) - 400, 0) AS dropped FROM ix", long="kept dropped")
def graph_counts(v):
    return knowledge.graph_counts(knowledge.entity_index(v("v_label")))


@book.add("""WITH sh AS (SELECT *, row_number() OVER (ORDER BY subj, pred, obj) AS r FROM v_edge ORDER BY subj, pred, obj LIMIT 60),
en AS (SELECT name, min(p) AS p FROM (SELECT subj AS name, r * 2 AS p FROM sh UNION ALL SELECT obj, r * 2 + 1 FROM sh) GROUP BY name), id AS (SELECT name, concat('n', row_number() OVER (ORDER BY p) - 1) AS node FROM en)
SELECT subj, pred, obj, (SELECT count(*) FROM v_edge) AS total, (SELECT node FROM id WHERE name = subj) AS subj_node, (SELECT node FROM id WHERE name = obj) AS obj_node FROM sh""")
def relation_graph(v):
    return knowledge.relation_graph(v("v_edge"))


def names(v) -> DataFrame:
    """Names and types of parts; some with their brand in parentheses, some wholly in parentheses, some in capitals."""
    label = F.when(F.col("p_size") % 11 == 0, F.concat(F.lit("("), "p_type", F.lit(")"))).when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") "), "p_type")).when(F.col("p_size") % 7 == 0, F.concat_ws(" ", F.upper("p_name"), "p_type"))
    return v("part").select(label.otherwise(F.concat_ws(" ", "p_name", "p_type")).alias("label")).distinct()


TOKENS = r"""lb AS (SELECT DISTINCT CASE WHEN p_size % 11 = 0 THEN concat('(', p_type, ')') WHEN p_size % 5 = 0 THEN concat(p_name, ' (', p_brand, ') ', p_type) WHEN p_size % 7 = 0 THEN concat(upper(p_name), ' ', p_type) ELSE concat(p_name, ' ', p_type) END AS label FROM part),
t0 AS (SELECT label, list_distinct(list_filter(string_split_regex(regexp_replace(label, '\([^)]*\)', ' ', 'g'), '\s+'), lambda x: x <> '')) AS t FROM lb), tk AS (SELECT label, CASE WHEN len(t) = 0 THEN [label] ELSE t END AS t FROM t0)"""


@book.add(f"WITH {TOKENS} SELECT a.label AS a, b.label AS b FROM tk a JOIN tk b ON a.label < b.label WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.5")
def alias_pairs(v):
    return knowledge.alias_pairs(names(v))


#: Leaders: labels in order, each with those before it that it is alike to.
LEADERS = f"""{TOKENS}, pr AS MATERIALIZED (SELECT a.label AS a, b.label AS b FROM tk a JOIN tk b ON a.label < b.label WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.5),
st AS MATERIALIZED (SELECT label, row_number() OVER (ORDER BY label) AS i, coalesce(n, []) AS near FROM tk LEFT JOIN (SELECT b, list(a ORDER BY a) AS n FROM pr GROUP BY b) ON b = label),
gr AS (SELECT cast(0 AS bigint) AS i, cast('' AS varchar) AS label, cast('' AS varchar) AS leader, cast([] AS varchar[]) AS leaders UNION ALL
  SELECT i, label, coalesce(x, label), CASE WHEN x IS NULL THEN list_append(leaders, label) ELSE leaders END FROM (SELECT st.i, st.label, gr.leaders, list_filter(st.near, lambda y: list_contains(gr.leaders, y))[1] AS x FROM gr JOIN st ON st.i = gr.i + 1))"""


@book.add(f"WITH RECURSIVE {LEADERS} SELECT label, leader FROM gr WHERE i > 0")
def alias_groups(v):
    labels = names(v)
    return knowledge.alias_leaders(labels, saved(knowledge.alias_pairs(labels), "pairs"), folder(labels.sparkSession))


#: Pages link to pages after them, as far on as their targets are long; the last ones link to pages that are not there.
LINKS = "lk AS (SELECT DISTINCT page AS src, page + 3 * length(target) AS dst FROM v_links)"


def links(v) -> DataFrame:
    return v("v_links").select(F.col("page").alias("src"), (F.col("page") + 3 * F.length("target")).alias("dst")).distinct()


@book.add(f"WITH {LINKS} SELECT src, dst FROM lk WHERE dst NOT IN (SELECT page_id FROM pages)")
def broken_links(v):
    return knowledge.broken_links(links(v), v("pages").select(F.col("page_id").alias("page")))


@book.add(f"WITH RECURSIVE {LINKS}, r AS (SELECT cast(0 AS bigint) AS page UNION SELECT dst FROM r JOIN lk ON src = page) SELECT page_id AS page FROM pages WHERE page_id NOT IN (SELECT page FROM r)")
def orphan_pages(v):
    pages = v("pages").select(F.col("page_id").alias("page"))
    return knowledge.orphan_pages(links(v), pages, pages.filter("page = 0"), folder(pages.sparkSession))


#: Pages as files of a wiki in three forms of name; each links back and forth to others, to some that are missing, and by paths with blanks.
WIKI = """n AS (SELECT count(*) AS n FROM pages), kk AS (SELECT DISTINCT page AS src, (page * 7 + 3 * length(target)) % (n + 9) AS dst FROM v_links, n),
nm AS (SELECT i AS id, concat('wiki/entities/p', i, CASE i % 3 WHEN 0 THEN '' WHEN 1 THEN ' (a(b))' ELSE '((c))' END, '.md') AS page FROM (SELECT unnest(range(n + 9)) AS i FROM n)),
wl AS (SELECT k.src, k.dst, s.page AS src_page, d.page AS dst_page, substr(d.page, 15) AS leaf, k.dst % 3 <> 1 OR k.src % 2 = 0 AS clean FROM kk k JOIN nm s ON s.id = k.src JOIN nm d ON d.id = k.dst)"""


def wiki(v) -> DataFrame:
    """(page, text): each page of the given ones as Markdown, and an index that links to the first."""
    n = v("pages").count()
    path = lambda i: F.concat(F.lit("p"), i.cast("string"), F.element_at(F.array(F.lit(""), F.lit(" (a(b))"), F.lit("((c))")), (i % 3 + 1).cast("int")), F.lit(".md"))
    linked = v("v_links").select("page", ((F.col("page") * 7 + 3 * F.length("target")) % (n + 9)).alias("dst")).distinct()
    leaf = path(F.col("dst"))
    wrapped = (F.col("dst") % 3 == 1) & (F.col("page") % 2 == 0)
    text = F.when(wrapped, F.concat(F.lit("[x (y)](<"), leaf, F.lit(">)"))).otherwise(F.concat(F.lit("[x](../entities/./"), leaf, F.lit("#part (1)) and (so) ![i](a(b).png) [u](http://a.b/c.md)")))
    lines = linked.withColumn("line", text).groupBy("page").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"))
    pages = v("pages").select(F.col("page_id").alias("page")).join(lines, "page", "left").select(F.concat(F.lit("wiki/entities/"), path(F.col("page"))).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    index = v("pages").limit(1).select(F.lit("INDEX.md").alias("page"), F.lit("# All\n[first](wiki/entities/p0.md) [lost](wiki/none.md) [open](wiki/(x.md").alias("text"))
    return saved(pages.unionByName(index), "wiki")


@book.add(f"""WITH {WIKI}, rows AS (SELECT src_page AS src, CASE WHEN clean AND dst % 3 = 1 THEN concat('<', leaf, '>') ELSE concat('../entities/./', leaf, '#part (1)') END AS raw, CASE WHEN clean THEN dst_page END AS dst, dst AS id FROM wl)
SELECT src, raw, dst FROM rows, n WHERE dst IS NULL OR id >= n UNION ALL SELECT 'INDEX.md', 'wiki/none.md', 'wiki/none.md'""")
def wiki_broken_links(v):
    """Links of Markdown pages that lead nowhere, or have a raw blank."""
    pages = wiki(v)
    return knowledge.broken_links(knowledge.link_rows(pages), pages)


@book.add(f"WITH RECURSIVE {WIKI}, r AS (SELECT cast(0 AS bigint) AS id UNION SELECT dst FROM r JOIN wl ON src = id AND clean) SELECT page FROM nm, n WHERE id < n AND id NOT IN (SELECT id FROM r)")
def wiki_orphans(v):
    """Entity pages that no chain of links from the index reaches."""
    pages = wiki(v)
    found = knowledge.orphan_pages(knowledge.link_rows(pages), pages.filter("page LIKE 'wiki/entities/%.md'"), pages.filter("page = 'INDEX.md'").select("page"), folder(pages.sparkSession))
    return found


@book.add(f"WITH RECURSIVE {LINKS}, r AS (SELECT cast(0 AS bigint) AS page, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN lk ON src = page) SELECT page, min(depth) AS depth FROM r GROUP BY page")
def reachable_pages(v):
    root = v("pages").filter("page_id = 0").select(F.col("page_id").alias("page"))
    return knowledge.reachable(links(v), root, folder(root.sparkSession))


@book.add("SELECT old, min(new) AS new FROM (SELECT DISTINCT target AS old, page % 3 AS new FROM v_links) GROUP BY old HAVING count(*) = 1")
def rewrite_map(v):
    return knowledge.rewrite_map(v("v_links").select(F.col("target").alias("old"), (F.col("page") % 3).alias("new")))


CLAUSES = r"""cl AS (SELECT lang AS ws, trim(c) AS clause FROM (SELECT lang, unnest(string_split_regex(translate(l, '()', '  '), '[.!?。;,，—]+')) AS c FROM (SELECT lang, trim(unnest(string_split(text, chr(10)))) AS l FROM documents) WHERE l <> '' AND NOT regexp_matches(l, '^(#|\(|<!--)')) WHERE trim(c) <> ''),
lc AS (SELECT lang AS ws, trim(c) AS clause FROM (SELECT lang, unnest(string_split_regex(regexp_replace(text, '\([^()]*\)', ' ', 'g'), '[.!?。;—' || chr(10) || ']+')) AS c FROM documents
  UNION ALL SELECT lang, unnest(string_split_regex(p, '[.!?。;—' || chr(10) || ']+')) FROM (SELECT lang, unnest(regexp_extract_all(text, '\(([^()]*)\)', 1)) AS p FROM documents)) WHERE trim(c) <> ''),
ml AS (SELECT ws, regexp_extract_all(clause, '[가-힣]{2,}|[A-Za-z]{3,}') AS w, contains(clause, 'was') OR contains(clause, 'for') AS marked FROM lc),
onl AS (SELECT ws, term FROM (SELECT ws, marked, unnest(w) AS term FROM ml) WHERE term NOT IN ('was', 'for') GROUP BY ws, term HAVING bool_and(marked))"""


def narrative(v) -> tuple[DataFrame, DataFrame]:
    """Clauses of whole texts by the narrative rule, and terms that the same texts, by the ledger rule, have only with a marker."""
    each = lambda of: v("documents").select(F.col("lang").alias("ws"), F.explode(of(F.col("text"))).alias("clause"))
    return each(tx.narrative_clauses), saved(knowledge.qualified_only(each(lambda t: tx.clauses(t, True)), ["was", "for"]), "only")


@book.add(f"WITH {CLAUSES} SELECT ws, term FROM onl")
def qualified_only_terms(v):
    return narrative(v)[1]


@book.add(rf"""WITH {CLAUSES} SELECT DISTINCT m.ws, m.clause, o.term FROM (SELECT ws, clause, regexp_replace(unnest(string_split_regex(clause, '\s+')), '^[''"“”‘’«»『』「」·*_~`(\[{{<]+', '') AS x FROM cl WHERE NOT contains(clause, 'was') AND NOT contains(clause, 'for')) m JOIN onl o ON o.ws = m.ws AND starts_with(m.x, o.term)""")
def narrative_qualifier_drops(v):
    rows, only = narrative(v)
    return knowledge.qualifier_drops(only, rows, ["was", "for"])


@book.add("""WITH RECURSIVE s AS MATERIALIZED (SELECT label, trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-') AS base, row_number() OVER (ORDER BY label) AS i FROM (SELECT DISTINCT concat(split_part(p_name, ' ', 1), CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN '!' WHEN 2 THEN ' 2' WHEN 3 THEN ' 2 3' ELSE '?' END) AS label FROM part)),
g AS (SELECT cast(0 AS bigint) AS i, cast('' AS varchar) AS label, cast('' AS varchar) AS slug, cast([] AS varchar[]) AS used UNION ALL
  SELECT i, label, x, list_append(used, x) FROM (SELECT s.i, s.label, g.used, list_filter([CASE WHEN k = 1 THEN base ELSE concat(base, '-', k) END for k in range(1, 60)], lambda y: NOT list_contains(g.used, y))[1] AS x FROM g JOIN s ON s.i = g.i + 1))
SELECT label, slug FROM g WHERE i > 0""")
def unique_slugs(v):
    """Labels that differ by marks, and some that end with numbers as slugs do."""
    end = F.element_at(F.array(*map(F.lit, ("", "!", " 2", " 2 3", "?"))), F.col("p_size") % 5 + 1)
    return knowledge.unique_slugs(v("part").select(F.concat(F.split("p_name", " ")[0], end).alias("label")).distinct(), tx.slug(F.col("label")))
