"""Benchmark decontamination: word windows of documents against a hash set of the windows of test items.

Words are runs of digits, letters a-z (A-Z are lower-cased first) and
characters beyond ASCII. In UTF-8 all of the latter are bytes from 128 on, so
words are found on bytes. A window is `width` consecutive words of an item, or
the whole of an item that has fewer. Every window of a document that a bit
table of the items' window hashes lets through is looked up and compared as
text, so that no hit rests on a hash.

Up to BROADCAST (item, window) pairs, whose number and size are counted first,
the set itself is broadcast and one scan without a shuffle gives the hits.
Beyond that only a Bloom filter of at most 2 ** FILTER_BITS bits is broadcast;
the windows that pass it are joined to the items' windows by text and gathered
by the digest of their document's text. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, joined_by, materialize, pieces, record_batch
from .language_id import mixed

#: Consecutive words of a window.
WIDTH = 10
#: Most (item, window) pairs, and most bytes of their texts, that are broadcast as a set.
BROADCAST, BROADCAST_BYTES = 500_000, 64 << 20
#: Most bits of the filter, as a power of two, and the bits that it tests for a window.
FILTER_BITS, PROBES = 30, 4
#: Bytes of text whose words are hashed at a time, and the longest word that is hashed by byte tables.
SPAN, LONG_WORD = 1 << 19, 1 << 16

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_WORD = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122))
_CODE = mixed(np.arange(1, 257, dtype=np.uint64))
_STEP, _NEXT = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_STEP, SPAN + LONG_WORD + 1)
_DOWN = _powers(pow(_STEP, -1, 1 << 64), SPAN + 1)

HITS = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>>"
_SPAN_TYPE = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_WINDOWS = pa.schema([("item", pa.string()), ("width", pa.int32()), ("h", pa.int64()), ("words", pa.string())])
_FOUND = pa.schema([("key", pa.binary()), ("first", pa.int32()), ("width", pa.int32()), ("words", pa.string())])


@dataclass
class Words:
    """The words of a run of texts: lower-cased bytes, where words start and end, each one's text, the texts' first words and bytes."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def text(self, at: int, width: int) -> bytes:
        """The words from number `at` on, joined by single blanks."""
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.starts[at : at + width], self.ends[at : at + width], strict=True))


def words_of(texts: list[str]) -> Words:
    each = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.cumsum([0, *map(len, each)])
    low = _LOWER[np.frombuffer(b"".join(each), np.uint8)]
    inside = _IN_WORD[low]
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[offsets < len(low)]] = False  # a text's first byte follows no other
    after[offsets[offsets > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    return Words(low, starts, ends, row, np.searchsorted(row, np.arange(len(texts) + 1)), offsets)


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its bytes' codes times powers of a step, wherever the word stands."""
    out = np.empty(len(w.starts), np.uint64)
    at = 0
    while at < len(out):
        begin = int(w.starts[at])
        to = int(np.searchsorted(w.starts, begin + SPAN))
        part = w.low[begin : min(int(w.ends[to - 1]), int(w.starts[to - 1]) + LONG_WORD)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODE[part] * _UP[: len(part)], out=sums[1:])
        a, b = w.starts[at:to] - begin, np.minimum(w.ends[at:to] - begin, len(part))
        out[at:to] = (sums[b] - sums[a]) * _DOWN[a]
        at = to
    for k in np.flatnonzero(w.ends - w.starts > LONG_WORD):
        out[k] = xxhash.xxh64_intdigest(w.low[w.starts[k] : w.ends[k]].tobytes())
    return mixed(out)


def windows_of(w: Words, widths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hashes of the windows that start at each word, without regard to where texts end), widths ascending."""
    one = word_hashes(w)
    total = one.copy()
    for width in range(1, max(widths, default=0) + 1):
        if width > 1:
            total = total[:-1] * _NEXT + one[width - 1 :] if len(total) > 1 else total[:0]
        if width in widths:
            yield width, mixed(total)


def places(h: np.ndarray, bits: int, probes: int) -> Iterator[np.ndarray]:
    """The filter's bits of each hash: two halves of a second hash, one step of it for each probe."""
    other = mixed(h) | np.uint64(1)
    for _ in range(probes):
        yield h >> np.uint64(64 - bits)
        h = h + other


class Filter:
    """A Bloom filter of window hashes by width."""

    def __init__(self, n: int, probes: int = PROBES):
        self.bits = min(FILTER_BITS, max(16, int(n).bit_length() + 4))
        self.probes = probes
        self.table = np.zeros(1 << (self.bits - 3), np.uint8)

    def add(self, h: np.ndarray) -> None:
        for at in places(h, self.bits, self.probes):
            np.bitwise_or.at(self.table, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Indexes of the hashes that may be in the set."""
        found = np.arange(len(h))
        for at in places(h, self.bits, self.probes):
            at = at[found]
            found = found[(self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return found


def candidates(w: Words, table: Filter, widths: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first word, width, hash) of the windows inside one text that pass the filter."""
    for width, h in windows_of(w, widths):
        at = table.passes(h)
        at = at[w.row[at] == w.row[at + width - 1]]
        yield from zip(at.tolist(), [width] * len(at), h[at].tolist(), strict=True)


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item, width, h, words): the windows of each item, once. Null texts have none; a null item_id counts as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            w, items = words_of(texts), part.column(0).to_pylist()
            sizes = np.minimum(np.diff(w.first), width)
            for k, h in windows_of(w, sorted({int(x) for x in sizes if x})):
                rows = np.flatnonzero(sizes == k)
                at = np.concatenate([np.arange(w.first[r], w.first[r + 1] - k + 1) for r in rows])
                for lo in range(0, len(at), 4096):
                    some = at[lo : lo + 4096]
                    yield record_batch(_WINDOWS, [items[r] for r in w.row[some]], [k] * len(some), h[some].view(np.int64), [w.text(a, k).decode("utf-8", "surrogatepass") for a in some])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.mapInArrow(run, "item string, width int, h long, words string").distinct()


class WindowSet:
    """All (item, window) pairs, sorted by hash: texts in one buffer, items as places in the sorted list of their names."""

    def __init__(self, table: pa.Table):
        h = table["h"].to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.widths = h[order], sorted(set(table["width"].to_pylist()))
        names, self.items = np.unique(np.array(table["item"].to_pylist(), object)[order], return_inverse=True)
        self.names = names.tolist()
        each = [x.encode("utf-8", "surrogatepass") for x in table["words"].take(pa.array(order)).to_pylist()]
        self.ends, self.texts = np.cumsum([0, *map(len, each)]), b"".join(each)
        self.filter = Filter(len(h), 1)
        self.filter.add(self.hashes)

    def items_with(self, h: int, words: bytes) -> list[int]:
        lo, hi = (int(np.searchsorted(self.hashes, np.uint64(h), side=s)) for s in ("left", "right"))
        return [int(self.items[k]) for k in range(lo, hi) if self.texts[self.ends[k] : self.ends[k + 1]] == words]


def summary(w: Words, spans: list[tuple[int, int]], items: list[list[str]]) -> pa.StructArray:
    """The column `hits` of a run of texts, from (first word, width) of all hits and each text's sorted item names."""
    turn = np.zeros(len(w.starts) + 1, np.int64)
    for first, width in spans:
        turn[first] += 1
        turn[first + width] -= 1
    hit = np.cumsum(turn[:-1]) > 0
    n_hit = np.diff(np.r_[0, np.cumsum(hit)][w.first])
    at = np.flatnonzero(hit)
    apart = (np.diff(at) > 1) | (np.diff(w.row[at]) > 0)
    opens, closes = at[np.r_[True, apart]] if len(at) else at, at[np.r_[apart, True]] if len(at) else at
    runs: list[list[dict]] = [[] for _ in items]
    for r in np.flatnonzero(n_hit):
        begin, end = int(w.offsets[r]), int(w.offsets[r + 1])
        chars = np.r_[0, np.cumsum((w.low[begin:end] & 0xC0) != 0x80)]  # bytes 128 to 191 go on with a character
        own = w.row[opens] == r
        bounds = zip(chars[w.starts[opens[own]] - begin].tolist(), chars[w.ends[closes[own]] - begin].tolist(), strict=True)
        runs[r] = [{"start": a, "end": b} for a, b in bounds]
    columns = [pa.array(np.diff(w.first)), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(runs, pa.list_(_SPAN_TYPE))]
    return pa.StructArray.from_arrays(columns, names=["n_words", "n_hit", "items", "spans"])


def in_slices(each_slice):
    """An Arrow function of (text, ...) that takes slices of about SPAN bytes of text at a time; longer texts are taken alone."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for got in arrays:
            columns = list(got) if isinstance(got, tuple) else [got]
            batch = pa.RecordBatch.from_arrays(columns, ["text", *map(str, range(1, len(columns)))])
            parts = [each_slice(texts, *[c.to_pylist() for c in part.columns[1:]]) for part, texts in pieces(iter([batch]), "text", SPAN)]
            yield pa.concat_arrays(parts) if parts else summary(words_of([]), [], [])

    return run


def hits_by_set(docs: DataFrame, pairs: DataFrame, hits: str) -> DataFrame:
    """docs with the column `hits`, from a set of all windows that every worker holds."""
    held = docs.sparkSession.sparkContext.broadcast(WindowSet(pairs.toArrow()))

    def each_slice(texts: list[str]) -> pa.StructArray:
        w, known = words_of(texts), held.value
        spans, items = [], [set() for _ in texts]
        for at, width, h in candidates(w, known.filter, known.widths):
            if with_it := known.items_with(h, w.text(at, width)):
                spans.append((at, width))
                items[w.row[at]].update(with_it)
        return summary(w, spans, [[known.names[k] for k in sorted(x)] for x in items])

    run = in_slices(each_slice)
    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(hits, F.arrow_udf(run, HITS)(docs["text"]))


def built_filter(pairs: DataFrame, size: int) -> Filter:
    """The Bloom filter of the pairs' windows; its blocks of 32 KiB are made by tasks."""
    whole = Filter(size)
    block = min(whole.bits, 18)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in places(batch.column(0).to_numpy().view(np.uint64), whole.bits, whole.probes):
                yield record_batch(pa.schema([("block", pa.int32()), ("place", pa.int32())]), (at >> np.uint64(block)).astype(np.int32), (at & np.uint64((1 << block) - 1)).astype(np.int32))

    def gathered(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << block, bool)
        bits[table["place"].to_numpy()] = True
        return pa.table({"block": table["block"].slice(0, 1), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    made = pairs.select("h").distinct().mapInArrow(spread, "block int, place int").groupBy("block").applyInArrow(gathered, "block int, bits binary")
    for row in made.toLocalIterator():
        at = row["block"] << (block - 3)
        whole.table[at : at + (1 << (block - 3))] = np.frombuffer(row["bits"], np.uint8)
    return whole


def hits_by_join(docs: DataFrame, pairs: DataFrame, size: int, hits: str) -> DataFrame:
    """docs with the column `hits`, where the items' windows are too many to broadcast.

    Windows that pass the filter leave with the digest of their text, once for
    each place; equal texts are looked up once. Common windows are joined by
    broadcast, so that no window fills a task.
    """
    widths = sorted(r[0] for r in pairs.select("width").distinct().collect())
    held = docs.sparkSession.sparkContext.broadcast(built_filter(pairs, size))
    key, spans, items = (fresh(docs, c) for c in ("text_key", "hit_spans", "hit_items"))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text", SPAN):
            w, keys = words_of(texts), part.column(0).to_pylist()
            found = [(keys[r := int(w.row[at])], at - int(w.first[r]), width, w.text(at, width).decode("utf-8", "surrogatepass")) for at, width, _ in candidates(w, held.value, widths)]
            for lo in range(0, len(found), 4096):
                yield record_batch(_FOUND, *map(list, zip(*found[lo : lo + 4096], strict=True)))

    text_key = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    keyed = docs.withColumn(key, text_key)
    seen = materialize(keyed.select(F.col(key).alias("key"), "text").mapInArrow(passing, "key binary, first int, width int, words string").distinct(), "seen")
    common = materialize(seen.groupBy("words").agg(F.count("*").alias("n")).join(pairs.select("words").distinct(), "words"), "common")
    real = materialize(joined_by(seen, common, "words", "n", seen.count()), "real")
    named = joined_by(real.select("key", "words").distinct(), common, "words", "n", seen.count()).join(pairs.select("words", "item"), "words")
    by_text = (
        real.groupBy("key").agg(F.collect_set(F.struct("first", "width")).alias("spans"))
        .join(named.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items")), "key")
        .select(F.col("key").alias(key), F.col("spans").alias(spans), F.col("items").alias(items))
    )

    def each_slice(texts: list[str], spans: list, items: list) -> pa.StructArray:
        w = words_of(texts)
        return summary(w, [(int(w.first[r]) + x["first"], x["width"]) for r, own in enumerate(spans) for x in own or ()], [x or [] for x in items])

    run = in_slices(each_slice)
    run.__annotations__ = {"arrays": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return keyed.join(by_text, key, "left").withColumn(hits, F.arrow_udf(run, HITS)("text", spans, items)).drop(key, spans, items)


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, hits: str = "hits", most: int = BROADCAST) -> DataFrame:
    """docs with the struct `hits`: n_words, n_hit, items (item_ids as sorted strings) and spans of hit characters.

    A word is hit inside any occurrence of a window of a benchmark item
    (item_id, text); spans join words in a row, ends excluded, and count
    characters of the text. Null and wordless texts have no words, on either
    side; a null item_id counts as ''; rows that share an item_id are one item;
    rows of docs that repeat stay; other columns pass through; with an empty
    benchmark nothing is hit. Items' windows up to `most` are broadcast.
    """
    pairs = materialize(item_windows(benchmark, width), "windows")
    size, chars = pairs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words") + F.octet_length("item")), F.lit(0))).first()
    if size <= most and chars <= BROADCAST_BYTES:
        return hits_by_set(docs, pairs, hits)
    return hits_by_join(docs, pairs, size, hits)


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", width: int = WIDTH, most: int = BROADCAST) -> DataFrame:
    """docs without what the benchmark has: hit spans are cut out of the texts, or documents with any go ("documents").

    Null texts stay null; a text of hit words alone becomes empty.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    hits = fresh(docs, "hits")
    found = find(docs, benchmark, width, hits, most)
    if remove == "documents":
        return found.filter(F.col(hits)["n_hit"] == 0).drop(hits)
    spans = F.col(hits)["spans"]
    bounds = F.concat(F.array(F.lit(0)), F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))), F.array(F.char_length("text")))
    kept = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda k: F.substring("text", bounds[2 * k] + 1, bounds[2 * k + 1] - bounds[2 * k]))
    return found.withColumn("text", F.when(F.col(hits)["n_hit"] > 0, F.array_join(kept, "")).otherwise(F.col("text"))).drop(hits)
