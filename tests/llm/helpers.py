"""Rows that every operator must take: nulls in any column, empty and long texts, ties, repeats, clashing names."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")
#: Names that clash with columns the operators make.
CLASH = ["fp", "h", "n_words", "verdict", "size", "near_key", "mixed", "key", "shard", "slot", "media", "Language_Text"]

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
TEXTS = [
    None, "", " \t\n", "a", "Re.", "One two three", "same text here " * 30, "same text here " * 30, LONG, LONG + " end",
    "Ünïcödé çà et là, déjà vu. " * 12, "123 456 !!! ###", "x\x1cy\x85z <|endoftext|> don'T", "\n".join(["a line of words"] * 5 + ["other"]),
    "The quick brown fox jumps over the lazy dog and " * 20, "the quick brown fox jumps over the lazy dog and " * 20,
]


def odd_docs(spark):
    """doc_id repeats, is null twice; lang and source have nulls; every clashing name is there."""
    ids = [*range(len(TEXTS) - 2), None, None]
    rows = [(i, t, ["en", "fr", None][k % 3], [None, "s1", "s2"][k % 3], None if t is None else len(t), *[k] * len(CLASH)) for k, (i, t) in enumerate(zip(ids, TEXTS, strict=True))]
    rows += [rows[3], rows[6], rows[6]]
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH)
    return spark.createDataFrame(rows, names)


def labels_of(spark, docs):
    rows = [(r["doc_id"], (r["doc_id"] or 0) % 2, (r["doc_id"] or 0) % 3 == 0) for r in docs.select("doc_id").collect()]
    rows += [(1, None, None), (None, 1, True)]
    return spark.createDataFrame([(a, b, None if c is None else int(c)) for a, b, c in rows], "doc_id long, quality int, toxic int")


def words(text):
    return WORD.findall(text or "")
