"""Queries of readers and sinks: timeline folders are written from the given tables, a folder per timeline, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..functions import times as tm
from ..operators import transcript
from ..sources import readers
from ..sources.tables import folder
from .base import Book

book = Book()

#: Files that Spark writes.
FILES = "part-*"


def written(rows: DataFrame, by: list[str], order: str | None = None) -> str:
    """The root of folders `by`=value that hold the text column `value`, each in one file, in the order of a column.

    A file costs the more the smaller it is, so folders are dealt out by a
    fixed number of partitions: by their bytes Spark would join small ones.
    """
    spark = rows.sparkSession
    root = f"{folder(spark)}/timelines-{uuid.uuid4().hex}"
    placed = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)
    placed = placed.sortWithinPartitions(*by, order) if order else placed
    placed.select("value", *by).write.partitionBy(*by).text(root)
    return root


def json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def key(column: str = "ws") -> Column:
    """The number at the end of 'ws=12'."""
    return F.regexp_extract(column, r"ws=(\d+)$", 1).cast("long").alias("ws")


@book.add("SELECT ws, concat('grp=', grp) AS grp, duration, ws % 3 = 0 AS has_audio, CASE WHEN ws % 2 = 0 THEN 29.97e0 END AS fps FROM v_videos")
def read_videos(v):
    """Manifests below a group; odd ones lack a frame rate."""
    manifest = json(F.col("duration"), (F.col("ws") % 3 == 0).alias("has_audio"), F.when(F.col("ws") % 2 == 0, 29.97).alias("fps"))
    root = written(v("v_videos").select("ws", "grp", manifest.alias("value")), ["grp", "ws"])
    found = readers.read_videos(v("v_videos").sparkSession, root, FILES)
    return found.select(key(), "grp", "duration", "has_audio", "fps")


def segment_files(v) -> str:
    """transcript files: every third id is a string, every fifth turn has its ends turned round."""
    seg = v("v_seg")
    number, quoted = json(F.col("pos").alias("id"), *times(), F.col("text")), json(F.concat(F.lit(" "), F.col("pos").cast("string")).alias("id"), *times(), F.col("text"))
    each = seg.select("ws", "pos", F.when(F.col("pos") % 3 == 0, quoted).otherwise(number).alias("item"))
    whole = each.groupBy("ws").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), ","), F.lit("]")).alias("value"))
    return written(whole, ["ws"])


def times() -> list[Column]:
    turned = F.col("pos") % 5 == 4
    return [F.when(turned, F.col("e")).otherwise(F.col("s")).alias("start"), F.when(turned, F.col("s")).otherwise(F.col("e")).alias("end")]


@book.add("SELECT ws, pos, CASE WHEN pos % 3 = 0 THEN 'string' ELSE 'number' END AS id_kind, cast(pos AS varchar) AS id_key, s, e, text FROM v_seg WHERE pos % 5 <> 4", long="pos")
def read_segments(v):
    found = readers.read_segments(v("v_seg").sparkSession, segment_files(v), FILES)
    return found.select(key(), "pos", "id_kind", "id_key", "s", "e", "text")


@book.add("SELECT ws, count(*) AS segments, sum(length(text)) AS chars FROM v_seg WHERE s < e AND s >= 0 GROUP BY ws", long="chars")
def valid_segments(v):
    """Segments of which each second copy is broken: an end before the start or none."""
    seg = v("v_seg").select("ws", "pos", "s", "e", "text")
    wrong = F.col("pos") % 2 == 0
    broken = seg.select("ws", "pos", "s", F.when(wrong, F.col("s") - 1).alias("e"), "text")  # null where the place is odd
    return transcript.valid_segments(seg.unionByName(broken)).groupBy("ws").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"))


def ledger_files(v) -> str:
    """Ledgers with a line that is no JSON for each hypothesis that is a draft, and an empty line before each tenth."""
    log = v("v_cp_log")
    line = json(F.col("cp_id").alias("id"), F.array("s", "e").alias("span"), "status", "hypothesis", "confidence")
    each = log.select("ws", "line_no", F.when(F.col("status") == "draft", F.lit("{draft")).when(F.col("line_no") % 10 == 0, F.lit("")).otherwise(line).alias("value"))
    return written(each, ["ws"], "line_no")


@book.add("""SELECT ws, line_no, cp_id, status, s, e, confidence FROM v_cp_log WHERE status <> 'draft' AND line_no % 10 <> 0""")
def read_ledger(v):
    spark = v("v_cp_log").sparkSession
    lines, _ = readers.read_ledger(spark, ledger_files(v), FILES)
    found = readers.claims(lines, lines.select("ws").distinct().withColumn("duration", F.lit(600.0)))
    return found.select(key(), "line_no", "cp_id", "status", "s", "e", "confidence")


@book.add("SELECT ws, line_no, 'not JSON' AS reason FROM v_cp_log WHERE status = 'draft'")
def ledger_rejects(v):
    return readers.read_ledger(v("v_cp_log").sparkSession, ledger_files(v), FILES)[1].select(key(), "line_no", "reason")


@book.add("SELECT ws, pos AS cue, s, e, text FROM (SELECT ws, row_number() OVER (PARTITION BY ws ORDER BY pos) AS pos, s, e, array_to_string(list_filter([trim(x) for x in string_split(regexp_replace(text, '[<>]', '', 'g'), chr(10))], lambda y: y <> ''), ' ') AS text FROM v_seg)")
def parse_captions(v):
    """Transcripts as caption texts with tags, and back to cues."""
    stamp = lambda t: F.concat(tm.srt_ts(F.col(t)))
    plain = F.regexp_replace("text", "[<>]", "")
    cue = F.concat(F.col("pos").cast("string"), F.lit("\n"), stamp("s"), F.lit(" --> "), stamp("e"), F.lit("\n<i>"), plain, F.lit("</i>\n"))
    each = v("v_seg").select("ws", "pos", cue.alias("cue"))
    texts = each.groupBy("ws").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cue"))), lambda x: x["cue"]), "\n").alias("value"))
    return readers.parse_captions(texts.withColumn("file", F.lit("a.srt"))).select("ws", F.col("cue").cast("long").alias("cue"), "s", "e", "text")


@book.add("""SELECT ws, CASE WHEN ws % 4 = 0 THEN concat('v', ws, '.ko.vtt') WHEN ws % 4 = 1 THEN concat('v', ws, '.ko-orig.vtt') WHEN ws % 4 = 2 THEN concat('v', ws, '.en.srt') ELSE concat('v', ws, '.de.srt') END AS file FROM v_videos""")
def pick_caption(v):
    ends = F.array(*map(F.lit, (".ko.vtt", ".ko-orig.vtt", ".en.srt", ".de.srt", ".fr.srt")))
    each = v("v_videos").select("ws", F.explode(F.slice(ends, (F.col("ws") % 4 + 1).cast("int"), F.lit(5))).alias("end"))
    return readers.pick_caption(each.select("ws", F.concat(F.lit("v"), F.col("ws").cast("string"), F.col("end")).alias("file")))


@book.add("""SELECT p_partkey AS ws, CASE WHEN p_size % 5 <> 0 THEN cast(p_size AS double) END AS duration, CASE WHEN p_size % 4 <> 0 THEN p_size * 16 END AS width, CASE WHEN p_size % 4 = 0 OR p_size % 7 = 0 THEN 0 WHEN p_size % 3 = 0 THEN 30000 / 1001 ELSE 25e0 END AS fps, p_size % 2 = 0 AS has_audio, CASE WHEN p_size % 4 = 0 THEN 'no video stream' WHEN p_size % 5 = 0 THEN 'no duration' END AS error FROM part""", long="width")
def normalize_probe(v):
    rate = F.when(F.col("p_size") % 7 == 0, "N/A").when(F.col("p_size") % 3 == 0, "30000/1001").otherwise("25/1")
    height = F.lit(8).alias("height")
    video = F.struct(F.lit("video").alias("codec_type"), (F.col("p_size") * 16).alias("width"), height, rate.alias("avg_frame_rate"), rate.alias("r_frame_rate"))
    audio = F.struct(F.lit("audio").alias("codec_type"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("string").alias("avg_frame_rate"), F.lit(None).cast("string").alias("r_frame_rate"))
    streams = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, audio), F.when(F.col("p_size") % 4 != 0, video)))
    probe = json(streams.alias("streams"), F.struct(F.when(F.col("p_size") % 5 == 0, "N/A").otherwise(F.col("p_size").cast("string")).alias("duration")).alias("format"))
    found = readers.normalize_probe(v("part").select(F.col("p_partkey").alias("ws"), probe.alias("value")))
    return found.select("ws", "duration", "width", "fps", "has_audio", "error")


@book.add("SELECT ws, files, bytes FROM (SELECT concat('grp=', grp, '/ws=', v.ws) AS ws, 1 AS files, sum(length(h.t)) + count(*) AS bytes FROM v_videos v JOIN (SELECT user_id AS ws, event_type AS t FROM events) h USING (ws) GROUP BY ALL)", long="files bytes")
def file_inventory(v):
    """Files of timelines two folders below the root, each booked under its own."""
    rows = v("events").select(F.col("user_id").alias("ws"), F.col("event_type").alias("value"), F.concat(F.lit("grp"), (F.col("user_id") % 7).cast("string")).alias("grp"))
    root = written(rows, ["grp", "ws"])
    found = readers.file_inventory(rows.sparkSession, root, "part-.*")
    return found.groupBy("ws").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@book.add("SELECT concat('ws=', page_id) AS page, html AS text FROM pages")
def read_pages(v):
    root = written(v("pages").select(F.col("page_id").alias("ws"), F.col("html").alias("value")), ["ws"])
    found = readers.read_pages(v("pages").sparkSession, root, FILES)
    return found.select(F.regexp_replace("page", "/[^/]*$", "").alias("page"), F.regexp_replace("text", "\n$", "").alias("text"))


@book.add("SELECT ws, label, t, conf FROM v_hits")
def write_and_read(v):
    """Results written as JSON, a folder per timeline, and read again."""
    hits = v("v_hits")
    path = f"{folder(hits.sparkSession)}/hits-{uuid.uuid4().hex}"
    readers.write_table(hits.repartition("ws"), path, "json")
    return hits.sparkSession.read.schema("label string, t double, conf double, ws long").json(path).select("ws", "label", "t", "conf")


# values of fields and names


#: JSON values of a part: arrays in arrays, objects whose label is a text, an array or missing, and texts that look like JSON.
PART_JSON = """[{{"label": " {name} ", "basis": ["{brand}"]}}, [["{type}"], "  ", {{"label": ["{brand}"]}}, [[{{"x": {{"label": "deep"}}}}, "[{size}]"]]], {size}, null, {{"label": "q\\"{size}"}}]"""


@book.add("""SELECT p_partkey, [trim(p_name), p_type, concat('[', p_size, ']'), concat('q"', p_size)] AS labels,
  trim(concat_ws(' ', p_name, concat_ws(' ', concat(' ', p_name, ' '), p_brand, p_type, '  ', p_brand, 'deep', concat('[', p_size, ']'), concat('q"', p_size)), p_type)) AS words, [p_name] AS plain FROM part""")
def flat_labels(v):
    """Labels of nested JSON, a text of all its strings, and a label that is no JSON."""
    form = PART_JSON.replace("{{", "{").replace("}}", "}")
    items = F.lit(form)
    for key, column in (("name", "p_name"), ("brand", "p_brand"), ("type", "p_type"), ("size", F.col("p_size").cast("string"))):
        items = F.replace(items, F.lit("{" + key + "}"), column)
    words = lb.searchable_text(F.col("p_name"), F.lit(None).cast("string"), lb.said(items), F.array("p_type"))
    return v("part").select("p_partkey", readers.flatten_labels(items).alias("labels"), words.alias("words"), readers.flatten_labels(F.col("p_name")).alias("plain"))


@book.add("""SELECT p_partkey, concat('edge-', substr(sha256(concat('{"a":', p_size, ',"b":["', p_size, '",', p_size, '.5,{"x":null,"é":true}],"n":"', p_name, '","é":[]}')), 1, 16)) AS id FROM part""")
def stable_ids(v):
    """Ids of nested payloads: keys in any order, whole doubles, letters in two normal forms."""
    size = F.col("p_size").cast("string")
    one = F.concat(F.lit('{"é": [], "n": "'), "p_name", F.lit('", "b": ["'), size, F.lit('", '), size, F.lit('.5, {"é": true, "x": null}], "a": '), size, F.lit(".0}"))
    two = F.concat(F.lit('{"a":'), size, F.lit(',"b":["'), size, F.lit('",'), size, F.lit('.50,{"x":null,"é":true}],"n":"'), "p_name", F.lit('","é":[]}'))
    return v("part").select("p_partkey", lb.stable_id("edge", F.when(F.col("p_partkey") % 2 == 0, one).otherwise(two)).alias("id"))


@book.add("""SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE concat(regexp_replace(CASE WHEN length(h) - strpos(reverse(h), ' ') > 20 AND strpos(h, ' ') > 0 THEN h[1 : length(h) - strpos(reverse(h), ' ')] ELSE h END, '[ ,·—(-]+$', ''), '…') END AS short FROM (SELECT doc_id, text, text[1:40] AS h FROM documents)""")
def ellipsize(v):
    return v("documents").select("doc_id", tx.ellipsize(F.col("text"), 40).alias("short"))


@book.add(r"""SELECT page_id, list_filter([string_split(x, '#')[1] for x in regexp_extract_all(html, 'href="([^"]*)"', 1)], lambda x: true) AS targets FROM pages""")
def link_targets(v):
    """Links of pages as Markdown, with fragments."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    page = F.array_join(F.transform(hrefs, lambda x: F.concat(F.lit("see [it](<"), x, F.lit(".md#top>) ![no](a.png)"))), "\n")
    bare = F.transform(tx.link_targets(page), lambda x: F.regexp_replace(x, r"\.md$", ""))
    return v("pages").select("page_id", bare.alias("targets"))


@book.add("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN '30000/1001' WHEN o_custkey % 3 = 1 THEN '25/1' ELSE '24/1' END AS rate FROM orders""")
def frame_rates(v):
    """Rates as reduced fractions: decimals near a broadcast rate become that rate."""
    n = F.col("o_custkey") % 3
    rate = tm.frame_rate(F.when(n == 0, F.lit("29.97")).when(n == 1, F.lit("50/2")).otherwise(F.lit("24")))
    return v("orders").select("o_orderkey", F.concat(rate["num"].cast("string"), F.lit("/"), rate["den"].cast("string")).alias("rate"))


@book.add(f"""SELECT page_id, translate(regexp_replace(html, '{tx.NOISE}', ' ', 'g'), '{tx.MARKS.replace("'", "''")}', '{" " * len(tx.MARKS)}') AS words FROM pages""")
def clean_metadata(v):
    """Whole pages as metadata."""
    return v("pages").select("page_id", tx.clean_metadata_text(F.col("html")).alias("words"))


#: Reasons, tags and link targets made from parts; some reasons begin as known ones do.
NAMED = """nm AS (SELECT p_partkey, concat(CASE p_size % 4 WHEN 0 THEN 'burst @' WHEN 1 THEN 'ocr-scan every=' WHEN 2 THEN '--' ELSE '' END, p_name, ' / ', p_type, '!') AS reason, concat(' ', p_name, '  ', p_brand, chr(10)) AS tag,
concat(CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '_') ELSE p_name END, CASE WHEN p_size % 5 = 0 THEN ' <5%>' ELSE '.md' END, CASE WHEN p_size % 2 = 0 THEN concat('#', p_type, ' 50% %41=a:b~*(', p_brand) ELSE chr(9) END) AS target FROM {part})"""
NAMED_DUCK = NAMED.format(part="part")


@book.add(f"WITH {NAMED_DUCK}" + r""", pf AS (SELECT *, string_split(target, '#')[1] AS path, regexp_replace(CASE WHEN contains(target, '#') THEN target[strpos(target, '#') + 1 :] END, '%([0-9A-F]{2})', chr(1) || '\1', 'g') AS fr FROM nm),
en AS (SELECT *, replace(replace(replace(replace(replace(path, '%', '%25'), '<', '%3C'), '>', '%3E'), chr(9), '%09'), chr(10), '%0A') || CASE WHEN contains(target, '#') THEN '#' || replace(replace(replace(url_encode(fr), '%3D', '='), '%3A', ':'), '%01', '%') ELSE '' END AS made FROM pf)
SELECT p_partkey, coalesce('-' || nullif(rtrim(trim(regexp_replace(reason, '[^0-9A-Za-z가-힣-]+', '-', 'g'), '-')[1:40], '-'), ''), '') AS slug, regexp_replace(trim(tag, ' ' || chr(10)), '\s+', '-', 'g') AS tag,
CASE WHEN starts_with(reason, 'burst') THEN '오디오 피크 확인 (' || reason || ')' WHEN starts_with(reason, 'ocr-scan') THEN '자막·화면문자 스캔 (' || reason || ')' ELSE reason END AS label, CASE WHEN regexp_matches(made, '[ ()]') THEN '<' || made || '>' ELSE made END AS target FROM en""")
def name_functions(v):
    made = v("part").sparkSession.sql(f"WITH {NAMED} SELECT * FROM nm", part=v("part"))
    return made.select("p_partkey", tx.reason_slug(F.col("reason")).alias("slug"), tx.tag_format(F.col("tag")).alias("tag"), lb.reason_label(F.col("reason")).alias("label"), lb.md_target(F.col("target")).alias("target"))


@book.add(r"""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(x, '[\\/:*?"<>|#\[\]^\n]', '_', 'g'))[1:80], ''), '_') AS slug,
  replace(replace(replace(regexp_replace(regexp_replace(x, '\s*[\r\n]+\s*', ' ', 'g'), '([\\`*_{}\[\]()#+!|~-])', '\\\1', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS inert
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat(' ', p_name, ': <', p_type, '> [a](b)', chr(10), '  # x') WHEN 1 THEN ' ' WHEN 2 THEN repeat(concat(p_name, '/'), 9) ELSE concat('R&D *', p_brand, '* 영상 ~|') END AS x FROM part)""")
def page_names(v):
    """Labels as file names and as inert Markdown."""
    n = F.col("p_size") % 4
    x = F.when(n == 0, F.concat(F.lit(" "), "p_name", F.lit(": <"), "p_type", F.lit("> [a](b)\n  # x"))).when(n == 1, " ").when(n == 2, F.repeat(F.concat("p_name", F.lit("/")), F.lit(9))).otherwise(F.concat(F.lit("R&D *"), "p_brand", F.lit("* 영상 ~|")))
    return v("part").select("p_partkey", tx.entity_slug(x).alias("slug"), lb.escape_markdown(x).alias("inert"))


@book.add("SELECT ws, CASE ws % 4 WHEN 1 THEN 0 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE n END AS n FROM (SELECT ws, count(*) AS n FROM v_seg GROUP BY ws)", long="n")
def signal_counts(v):
    """Signal files: with items, with none, broken, and not there."""
    seg = v("v_seg").groupBy("ws").agg(F.to_json(F.collect_list(F.struct("pos", "s"))).alias("items"))
    value = F.when(F.col("ws") % 4 == 1, "[]").when(F.col("ws") % 4 == 2, "{").otherwise(F.col("items"))
    root = written(seg.filter("ws % 4 <> 3").select("ws", value.alias("value")), ["ws"])
    found = readers.signal_counts(seg.sparkSession, root, seg.select(F.concat(F.lit("ws="), F.col("ws").cast("string")).alias("ws")), FILES)
    return found.select(key(), "n")
