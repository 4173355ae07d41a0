import itertools

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from spanlake.llm import simhash
from spanlake.llm.language_id import mixed

from .helpers import odd_docs, words


def brute_print(text, width=4):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    grams = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, prints, radius=4):
    """Least id reachable over near fingerprints, by repeated passes."""
    near = [[j for j in range(len(ids)) if (prints[i] ^ prints[j]).bit_count() <= radius] for i in range(len(ids))]
    best = list(ids)
    for _ in range(len(ids)):
        best = [min((best[j] for j in n if best[j] is not None), default=None) for n in near]
    return best


def check(rows, texts, ids):
    prints = [brute_print(t) for t in texts]
    expected = sorted(zip(ids, prints, brute_components(ids, prints), strict=True), key=repr)
    found = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows), key=repr)
    assert found == expected


def test_odd_rows(spark):
    docs = odd_docs(spark)
    given_rows = docs.select("doc_id", "text").collect()
    check(simhash.near_duplicates(docs).collect(), [r["text"] for r in given_rows], [r["doc_id"] for r in given_rows])
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_whole_table(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    check(simhash.near_duplicates(docs).collect(), [r["text"] for r in rows], [r["doc_id"] for r in rows])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30), st.integers(0, 7), st.data())
def test_bit_slices_find_all_pairs(seeds, radius, data):
    fps = list(seeds)
    for s in seeds:  # near ones, at every distance up to one over the radius
        for bits in range(radius + 2):
            for b in data.draw(st.lists(st.integers(0, 63), min_size=bits, max_size=bits, unique=True)):
                s ^= 1 << b
            fps.append(s)
    fps = np.array(fps, np.uint64)
    group = np.sort(np.arange(len(fps)) % 3)
    found = {tuple(sorted(p)) for u, v in simhash.near_pairs(fps, group, radius) for p in zip(u.tolist(), v.tolist(), strict=True)}
    assert found == {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if group[i] == group[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}


def test_keys_lose_no_pair_and_hot_keys_are_split(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(12)}
    fps |= {(0xABCDEF << 40) | int(x) for x in rng.integers(0, 2**12, 150)}  # one crowded key
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for chunk in (4096, 16):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(frame, 4, chunk)).collect()}
        best = brute_components(signed, [x % (1 << 64) for x in signed])
        assert [roots.get(x, x) for x in signed] == best


def test_keep_one(spark):
    docs = odd_docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = docs.select("doc_id", "text").collect()
    prints = [wide_print(r["text"]) for r in rows]
    group = brute_components(list(range(len(rows))), prints, 24)
    want = {g: min(((r["doc_id"] is None, r["doc_id"] or 0) for r, x in zip(rows, group, strict=True) if x == g)) for g in group}
    got = [((r["doc_id"] is None, r["doc_id"] or 0), r["text"]) for r in kept.collect()]
    assert sorted(k for k, _ in got) == sorted(want.values())
    number = {(i, t): g for (i, t), g in zip(((r["doc_id"], r["text"]) for r in rows), group, strict=True)}
    assert sorted(number[(None if none else i, t)] for (none, i), t in got) == sorted(want)


def test_rows_that_share_an_id_lose_no_text(spark):
    a, b = "one two three four five six seven", "entirely other words stand here in this text"
    for rows, want in (([(3, a), (5, a), (5, b)], [(3, a), (5, b)]), ([(7, a), (7, b)], [(7, a), (7, b)]), ([(None, a), (None, a), (None, b), (2, b)], [(2, b), (None, a)])):
        got = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_rows_are_told_apart_by_where_nulls_stand(spark, monkeypatch):
    text = "alpha beta gamma"
    rows = [(1, None, text), (1, text, None), (1, text, "NULL"), (1, text, "NULL"), (2, text, None)]
    for most in (simhash.BROADCAST, 0):
        monkeypatch.setattr(simhash, "BROADCAST", most)
        got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, title string")).collect()
        texts = [r["text"] for r in got]
        assert len(got) == 2 and set(texts) == {None, text} and all(r["doc_id"] == 1 for r in got)
    import datetime

    at = datetime.datetime(2024, 1, 1, 0, 0, 0)
    rows = [(1, t, at.replace(microsecond=k), [k and None, 1, k or None]) for k, t in enumerate(["one text of its own kind", "and another text of words"])]
    keys = spark.createDataFrame(rows + [(1, rows[0][1], rows[1][2], rows[0][3]), (1, rows[0][1], rows[0][2], [1, None, None])], "doc_id long, text string, at timestamp, k array<int>")
    assert keys.select(simhash.row_key(keys)).distinct().count() == 4


def wide_print(text, width=5):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    grams = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    hs = [h | int(x) << 64 for h, x in zip(hs, mixed(np.array(hs, np.uint64)).tolist(), strict=True)]
    return sum(1 << b for b in range(128) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_copies_are_found(spark):
    """Texts with random words replaced: of those at a similarity of 0.8 or more, nine in ten are linked, and no unlike ones."""
    rng = np.random.default_rng(8)
    vocabulary = [f"word{i}" for i in range(5000)]
    rows, similar = [], []
    for i in range(300):
        base = [vocabulary[k] for k in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        copy = list(base)
        for k in rng.choice(len(copy), max(1, int(len(copy) * rng.uniform(0.002, 0.02))), replace=False):
            copy[k] = "changed" + str(rng.integers(0, 10**9))
        grams = [{tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (base, copy)]
        similar.append(len(grams[0] & grams[1]) / len(grams[0] | grams[1]))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * i in kept for i in range(300))
    near = [i for i, s in enumerate(similar) if s >= 0.8]
    assert len(near) > 150 and sum(2 * i + 1 not in kept for i in near) >= 0.9 * len(near)


def test_crowded_probes_are_dealt_out(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (2, 2), dtype=np.uint64)
    fps = {tuple((b ^ np.array([sum(1 << int(k) for k in rng.choice(60, 2, replace=False)), 0], np.uint64)).tolist()) for b in base for _ in range(60)}
    data = [(np.array(x, "<u8").tobytes(), bytes([0, 1, 2] * 6)) for x in fps]
    frame = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in data], "fp binary, weak binary")
    for chunk in (4096, 16):
        roots = {bytes(r["node"]): bytes(r["root"]) for r in simhash.components(simhash.wide_links(frame, 20, 3, 24, chunk)).collect()}
        assert len(roots) == len(fps) and len(set(roots.values())) == 2


def test_a_hub_and_a_common_print(spark):
    """Links of one hub, and rows of one print, take the broadcast path and give the same components."""
    links = spark.createDataFrame([(i, 0) for i in range(1, 3000)] + [(5000 + i, 4000) for i in range(5)], "hi long, lo long")
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert len(roots) == 3006 and all(v == (0 if k < 3000 else 4000) for k, v in roots.items())
    docs = spark.createDataFrame([(i, "the same text in all of them") for i in range(2500)] + [(9000, "another text of its own kind")], "doc_id long, text string")
    assert {(r["component_id"], r["count"]) for r in simhash.near_duplicates(docs).groupBy("component_id").count().collect()} == {(0, 2500), (9000, 1)}
