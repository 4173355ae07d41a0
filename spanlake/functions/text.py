"""Text helpers: normal forms, tokens, particles, slugs, labels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """NFC normal form, which Spark has no function for."""
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """Lower case without diacritics."""
    return text.map(lambda x: x if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)).lower())


def tokens(folded: Column) -> Column:
    """Runs of letters and digits of a folded text."""
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def ellipsize(text: Column, n: int) -> Column:
    """The first n characters, cut at the last blank if that is past the half, without marks at the end, and an ellipsis; shorter texts as they are."""
    head = F.substring(text, 1, n)
    at_word = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
    cut = F.regexp_replace(F.when(F.length(at_word) > n // 2, at_word).otherwise(head), r"[ ,·—(-]+$", "")
    return F.when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit("…")))


def slug(text: Column, cap: int = 80) -> Column:
    """Lower-case letters and digits with single hyphens between, at most cap characters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(s, 1, cap), "-+$", "")


def file_stem(path: Column) -> Column:
    """Name without directory and suffix; runs of . _ - become a blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", ""), "[._-]+", " "))


#: What metadata holds beside words: links, handles, tags, clock times, ornaments; and marks that stand between words (fixed values).
NOISE = r"https?://\S+|@\S+|#\S+|\b\d{1,2}:\d{2}(?::\d{2})?\b|[▶►★☆♥♡]"
MARKS = "[]()<>{}|·,、/\\\"'“”‘’!?~*_"


def clean_metadata_text(text: Column) -> Column:
    """text with noise and marks as blanks; null becomes empty."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), NOISE, " "), MARKS, " " * len(MARKS))


def reason_slug(reason: Column, cap: int = 40) -> Column:
    """End of a file name that tells why it was taken: a hyphen and at most cap letters, digits and hyphens; empty where nothing is left of it."""
    kept = F.regexp_replace(F.regexp_replace(nfc(F.coalesce(reason, F.lit(""))), "[^0-9A-Za-z가-힣-]+", "-"), "^-+|-+$", "")
    short = F.regexp_replace(F.substring(kept, 1, cap), "-+$", "")
    return F.when(short == "", F.lit("")).otherwise(F.concat(F.lit("-"), short))


def entity_slug(label: Column, cap: int = 80) -> Column:
    """A label as a file name: what paths and links cannot hold becomes _, blanks at the ends go; _ where nothing is left. Case and letters stay."""
    named = F.substring(strip(F.regexp_replace(label, r'[\\/:*?"<>|#\[\]^\n]', "_")), 1, cap)
    return F.when(named == "", F.lit("_")).otherwise(named)


def tag_format(tag: Column) -> Column:
    """A tag without blanks: those inside become hyphens."""
    return F.regexp_replace(F.regexp_replace(tag, r"^\s+|\s+$", ""), r"\s+", "-")


def strip_suffix(token: Column, suffixes: list[str], stem: int = 2) -> Column:
    """token without one of the suffixes, the longest that leaves `stem` characters."""
    out = token
    for x in sorted(suffixes, key=len):  # the longest is tested first
        out = F.when(token.endswith(x) & (F.length(token) - len(x) >= stem), F.substring(token, F.lit(1), F.length(token) - len(x))).otherwise(out)
    return out


def repetition_ratio(text: Column, least: int = 12) -> Column:
    """Share of the most frequent blank-delimited token; 0 below `least` tokens."""
    words = F.array_sort(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    # the longest run of equal words in sorted order
    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(a, w):
        run = F.when(a["word"] == w, a["run"] + 1).otherwise(1)
        return F.struct(w.alias("word"), run.alias("run"), F.greatest(a["top"], run).alias("top"))

    top = F.aggregate(words, start, step, lambda a: a["top"])
    return F.when(F.size(words) < least, F.lit(0.0)).otherwise(top / F.size(words))


def strip(text: Column) -> Column:
    """text without blanks of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def link_destinations(markdown: Column) -> Column:
    """What stands in the parentheses of inline links, as written, with balanced parentheses inside to any depth.

    A fold over the text's brackets counts the open ones. A link that is never
    closed gives nothing, as does all that follows it.
    """
    pieces = F.regexp_extract_all(markdown, F.lit(r"\]\(|[()]|[^()\]]+|\]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        depth = F.when(a["depth"] == 0, (x == "](").cast("int")).otherwise(a["depth"] + x.isin("(", "](").cast("int") - (x == ")").cast("int"))
        closed = (a["depth"] > 0) & (depth == 0)
        held = F.when((a["depth"] > 0) & ~closed, F.concat(a["held"], x)).otherwise("")
        return F.struct(depth.alias("depth"), held.alias("held"), F.when(closed, F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def page_links(markdown: Column) -> Column:
    """array of (raw, target): inline links to .md files without scheme, as written, and without <>, blanks at the ends and fragment.

    target is null where it has a blank inside and no <> around: readers don't resolve such a link.
    """

    def one(raw):
        bare = strip(raw)
        wrapped = bare.startswith("<") & bare.endswith(">") & (F.length(bare) > 1)
        target = strip(F.substring_index(F.when(wrapped, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare), "#", 1))
        return F.struct(raw.alias("raw"), F.when(wrapped | ~F.contains(target, F.lit(" ")), target).alias("target"), (target.endswith(".md") & ~F.contains(target, F.lit("://"))).alias("page"))

    found = F.filter(F.transform(link_destinations(markdown), one), lambda x: x["page"])
    return F.transform(found, lambda x: F.struct(x["raw"], x["target"]))


def link_targets(markdown: Column) -> Column:
    """Targets of `page_links` that can be resolved."""
    return F.filter(F.transform(page_links(markdown), lambda x: x["target"]), lambda x: x.isNotNull())


def beside(page: Column, target: Column) -> Column:
    """The path of a target as seen from a page's folder, without . and .. parts; paths that begin with / stand for themselves."""
    from_root = target.startswith("/")
    whole = F.when(from_root, target).otherwise(F.concat(F.regexp_extract(page, r"^(.*/)?[^/]*$", 1), target))
    step = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x.isin("", "."), a).otherwise(F.concat(a, F.array(x)))
    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(from_root, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def lifted(text: Column) -> Column:
    """array: the text with a blank for each pair of parentheses, then what stands in each pair, inner ones first; those that have no partner stay."""
    pieces = F.regexp_extract_all(text, F.lit(r"[()]|[^()]+"), F.lit(0))
    start = F.struct(F.array(F.lit("")).alias("open"), F.array().cast("array<string>").alias("inner"))
    last = lambda a: F.element_at(a["open"], -1)
    below = lambda a, k: F.slice(a["open"], F.lit(1), F.size(a["open"]) - k)

    def step(a, x):
        closes = (x == ")") & (F.size(a["open"]) > 1)
        under = F.concat(F.get(a["open"], F.size(a["open"]) - 2), F.lit(" "))
        open_ = F.when(x == "(", F.concat(a["open"], F.array(F.lit("")))).when(closes, F.concat(below(a, 2), F.array(under))).otherwise(F.concat(below(a, 1), F.array(F.concat(last(a), x))))
        return F.struct(open_.alias("open"), F.when(closes, F.concat(a["inner"], F.array(last(a)))).otherwise(a["inner"]).alias("inner"))

    found = F.aggregate(pieces, start, step, lambda a: F.concat(F.array(F.array_join(a["open"], "(")), a["inner"]))
    return F.when(F.contains(text, F.lit("(")), found).otherwise(F.array(text))


def clauses(text: Column, lift_parentheses: bool) -> Column:
    """Trimmed clauses of a text: split at sentence marks and long dashes; parentheses, nested ones too, become clauses of their own, or else commas split too.

    Full-width stops and commas split as the others do.
    """
    parts = F.flatten(F.transform(lifted(text), lambda x: F.split(x, "[.!?。;—\n]+"))) if lift_parentheses else F.split(text, "[.!?。;,，—\n]+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def narrative_clauses(text: Column, label: str | None = None) -> Column:
    """Clauses of the lines of a narrative: headings, notes that begin with a parenthesis and comments are passed over, a label (a pattern) at a line's start goes, parentheses are read as blanks."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: (x != "") & ~x.rlike(r"^(#|\(|<!--)"))
    bare = F.transform(lines, lambda x: F.translate(F.regexp_replace(x, f"^(?:{label})", "") if label else x, "()", "  "))
    return F.flatten(F.transform(bare, lambda x: clauses(x, False)))


#: Marks that may stand ahead of a word (fixed values).
LEADING = r"""['"“”‘’«»『』「」·*_~`(\[{<]"""


def word_starts(clause: Column) -> Column:
    """Distinct blank-delimited words without marks ahead of them."""
    return F.array_distinct(F.filter(F.transform(F.split(clause, r"\s+"), lambda x: F.regexp_replace(x, f"^{LEADING}+", "")), lambda x: x != ""))


def json_strings(text: Column) -> Column:
    """array of (value, key, objects): the string values of a JSON text at any depth, in order; key is null outside of objects, objects counts those around.

    One fold over the text's marks and strings with the containers that are open.
    """
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    pieces = F.regexp_extract_all(text, F.lit(rf"{string}\s*:|{string}|[\[\]{{}}]"), F.lit(0))
    decoded = lambda x: F.get_json_object(F.concat(F.lit("["), x, F.lit("]")), "$[0]")
    kind = "array<struct<value:string,key:string,objects:int>>"
    start = F.struct(F.lit("").alias("open"), F.lit(None).cast("string").alias("key"), F.array().cast(kind).alias("out"))

    def step(a, x):
        quoted, is_key = x.startswith('"'), x.endswith(":") & x.startswith('"')
        opens, closes = x.isin("[", "{"), x.isin("]", "}")
        key = F.when(is_key, decoded(F.regexp_replace(x, r"\s*:$", ""))).when(opens, F.lit(None)).otherwise(a["key"])
        found = F.struct(decoded(x).alias("value"), F.when(a["open"].endswith("{"), a["key"]).alias("key"), (F.length(a["open"]) - F.length(F.replace(a["open"], F.lit("{"), F.lit("")))).cast("int").alias("objects"))
        open_ = F.when(opens, F.concat(a["open"], x)).when(closes, F.substring(a["open"], F.lit(1), F.length(a["open"]) - 1)).otherwise(a["open"])
        return F.struct(open_.alias("open"), key.alias("key"), F.when(quoted & ~is_key, F.concat(a["out"], F.array(found))).otherwise(a["out"]).cast(kind).alias("out"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def is_container(text: Column) -> Column:
    """Whether a text is a JSON array or object."""
    return F.coalesce(text.rlike(r"^\s*[\[{]") & F.try_parse_json(text).isNotNull(), F.lit(False))
