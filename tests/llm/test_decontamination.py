"""Benchmark decontamination against brute force: both ways, odd rows, spans and removal."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanlake.llm import decontamination

from .helpers import TEXTS, odd_docs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(texts, items, width=10):
    """(n_words, n_hit, items, spans) of each text, by comparing every place with every window."""
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(UPPER))
        for i in range(max(len(w) - width + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        found = list(WORD.finditer((text or "").translate(UPPER)))
        w, hit, names = [m.group() for m in found], set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if got := windows.get(tuple(w[i : i + k])):
                    names |= got
                    hit |= set(range(i, i + k))
        spans = []
        for i in sorted(hit):
            if spans and i - 1 in hit:
                spans[-1][1] = found[i].end()
            else:
                spans.append([found[i].start(), found[i].end()])
        out.append((len(w), len(hit), sorted(names), [tuple(s) for s in spans]))
    return out


def cases():
    rng = random.Random(3)
    vocabulary = ["a", "The", "Ünï", "x1", "日本語", "don", "t", "42", "longer", "ÀB"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "…! "]) for _ in range(n))
    items = [(k % 37, text(rng.choice([0, 1, 3, 9, 10, 11, 30]) + 4 * (k % 2))) for k in range(60) if k % 5] + [(None, "null item of just these words"), (900, None), (901, " \t"), (902, "same text here same text here same text here same text here")]
    items += [(i, "a passage that very many of the items hold in common " + text(3)) for i in range(1000, 1040)]
    texts = [text(rng.choice([0, 1, 5, 12, 200])) for _ in range(60)]
    whole = [x for _, x in items if x and len(x) > 30]
    texts += [f"{text(3)}{rng.choice(whole).upper() if k % 2 else rng.choice(whole)} {text(4)}" for k in range(60)]
    return [*texts, *TEXTS, "a passage that very many of the items hold in common " * 2, "q" * 200_000 + " x1 x1"], items


@pytest.mark.parametrize("most", [10**6, 0])
@pytest.mark.parametrize("width", [10, 3])
def test_hits_equal_brute_force(spark, most, width):
    texts, items = cases()
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, hits int").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find(docs, benchmark, width, "found", most)
    got = {r["doc_id"]: (r["found"]["n_words"], r["found"]["n_hit"], r["found"]["items"], [tuple(s) for s in r["found"]["spans"]]) for r in found.collect()}
    want = brute(texts, items, width)
    assert [got[i] for i in range(len(texts))] == want
    assert 20 < sum(1 for x in want if x[1]) < len(want) - 20


def test_removal(spark):
    benchmark = spark.createDataFrame([(7, "One two, three four"), (8, "über")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so: ONE two three four! Über"), (2, "one two three"), (3, None), (4, "one two three four"), (4, "one two three four")], "doc_id long, text string")
    cut = sorted(decontamination.clean(docs, benchmark).collect(), key=lambda r: (r[0], r[1] or ""))
    assert [tuple(r) for r in cut] == [(1, "so: ! Über"), (2, "one two three"), (3, None), (4, ""), (4, "")]
    assert sorted(r[0] for r in decontamination.clean(docs, benchmark, "documents").collect()) == [2, 3]
    with pytest.raises(ValueError):
        decontamination.clean(docs, benchmark, "lines")


def test_odd_rows_and_empty_tables(spark):
    docs = odd_docs(spark)
    benchmark = docs.select(F.col("doc_id").alias("item_id"), "text", F.col("fp").alias("hits"))
    got = decontamination.find(docs, benchmark)
    assert got.columns == [*docs.columns, "hits"] and got.count() == docs.count()
    assert got.filter("hits.n_words > 0 and hits.n_hit < hits.n_words").isEmpty()  # each text is its own item
    for most in (10, 0):
        none = decontamination.find(docs, benchmark.limit(0), most=most)
        assert none.filter("hits.n_hit > 0").isEmpty() and none.count() == docs.count()
        assert decontamination.find(docs.limit(0), benchmark, most=most).collect() == []


def test_filter_has_no_false_negatives_and_few_false_positives():
    import numpy as np

    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    table = decontamination.Filter(len(h))
    table.add(h)
    assert len(table.passes(h)) == len(h)
    assert len(table.passes(rng.integers(0, 1 << 63, 200_000, dtype=np.uint64))) < 500
