"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared 64 at a time: the bits of 64 fingerprints at one
position form one 64-bit word (a bit plane), a query's bit flips it, and the
differing lanes are added to 64 counters at once with carry-save logic (counter
planes for 1, 2, 4, ... and a sticky overflow plane). A block of 64 lanes is
abandoned as soon as every counter is beyond the radius.

Which fingerprints meet at all is decided by keys. `near_links` follows the
pigeonhole principle and loses nothing: of `blocks` bit blocks, `blocks -
radius` are equal in any pair within the radius, so the pair shares the key of
at least one choice of that many blocks. `wide_links` serves radii for which
no such choice is selective: a key is one block of bits as it is and with each
subset of its weakest bits flipped, those whose counts were nearest to a draw,
which are the ones that an edit turns. Within a key only a spanning set of
links leaves the task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, joined_by, materialize, pieces, record_batch
from .language_id import mixed

#: Fingerprints of one key that one group compares; larger keys get further keys, or are dealt out as pairs of chunks.
CHUNK = 4096
#: Comparisons (query, block of 64 lanes) that are worked on at a time.
SPAN = 1 << 18
#: Of how many fingerprints one is counted to find large keys. This only deals work out; it changes no result.
COUNTED = 8

_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_WIDE = pa.schema([("least", pa.int64()), ("h", pa.binary()), ("fp", pa.binary()), ("weak", pa.binary())])
_KEYED = pa.schema([("fp", pa.binary()), ("band", pa.int32()), ("key", pa.int64())])


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64 (seed 42) of every shingle of `width` words, repeats included; A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z fold, only ASCII blanks split
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, 42)]
    ends = list(accumulate((len(w) + 1 for w in words)))
    return [digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[width - 1 :], strict=False)]


def hashes_of(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, number of each text's)."""
    each = [shingle_hashes(t, width) for t in texts]
    sizes = np.array([len(x) for x in each], np.int64)
    return np.fromiter((h for x in each for h in x), np.uint64, int(sizes.sum())), sizes


def margins(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(runs, 64): in a run of hashes, how many more have a bit than have it not; empty runs: 0."""
    out, full = np.zeros((len(sizes), 64), np.int32), sizes > 0
    if full.any():
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int32) - sizes[full, None].astype(np.int32)
    return out


def packed(margin: np.ndarray) -> np.ndarray:
    """Fingerprints, 64 bits a word: a bit is set where over half of the run has it."""
    return np.packbits(margin > 0, axis=1, bitorder="little").view("<u8")


def fold_fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint for each run of hashes."""
    return packed(margins(hashes, sizes)).ravel()


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; null text counts as empty, and a text without words gets 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            yield record_batch(_FP, part.column(0), fold_fingerprints(*hashes_of(texts, width)).view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def bit_planes(lanes: np.ndarray) -> np.ndarray:
    """(planes, n words) from (n words, 64 lanes, 64-bit words a fingerprint)."""
    n, _, w = lanes.shape
    bits = np.unpackbits(np.ascontiguousarray(lanes).astype("<u8").view(np.uint8).reshape(n, 64, 8 * w), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius; counters: planes for 1, 2, 4, ..., over: lanes that went past them all."""
    far, same = over.copy(), np.full_like(over, ~np.uint64(0))
    for k, plane in reversed(list(enumerate(counters))):
        if radius >> k & 1:
            same &= plane
        else:
            far |= same & plane
            same &= ~plane
    return far


#: Masks of the lowest k of 64 lanes.
_LOW = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


def near_pairs(fps: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (u, v), u < v, of fingerprints of one group that differ in at most `radius` bits.

    fps: (n, 64-bit words), or (n) of one word, sorted by group. Lanes of a
    word may be of several groups; a query minds those of its own after itself.
    """
    fps = fps.reshape(len(fps), -1)
    n = len(fps)
    last = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) if n else np.zeros(0, np.int64)
    end = np.repeat(last + 1, np.diff(np.r_[-1, last]))
    lanes = np.zeros((-(-n // 64) * 64, fps.shape[1]), np.uint64)
    lanes[:n] = fps
    planes = bit_planes(lanes.reshape(-1, 64, fps.shape[1]))
    asks = np.flatnonzero(end > np.arange(n) + 1)
    words = (end[asks] - 1) // 64 - (asks + 1) // 64 + 1
    done = np.cumsum(words)
    at = 0
    while at < len(asks):
        to = max(at + 1, int(np.searchsorted(done, (int(done[at - 1]) if at else 0) + SPAN, side="right")))
        m = words[at:to]
        q = np.repeat(asks[at:to], m)
        w = (q + 1) // 64 + np.arange(len(q)) - np.repeat(np.cumsum(m) - m, m)
        live = _LOW[np.clip(end[q] - 64 * w, 0, 64)] & ~_LOW[np.clip(q + 1 - 64 * w, 0, 64)]
        counters, over = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())], np.zeros(len(q), np.uint64)
        for b in range(len(planes)):
            carry = planes[b][w] ^ (((fps[q, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) - np.uint64(1)) ^ ~np.uint64(0)
            for k, plane in enumerate(counters):
                counters[k], carry = plane ^ carry, plane & carry
            over |= carry
            if b % 8 == 7 and b >= radius:
                keep = (~beyond(counters, over, radius) & live) != 0
                if not keep.all():
                    q, w, live, over = q[keep], w[keep], live[keep], over[keep]
                    counters = [x[keep] for x in counters]
                if not len(q):
                    break
        if len(q):
            near = ~beyond(counters, over, radius) & live
            hit, lane = np.nonzero(np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[hit], 64 * w[hit] + lane
        at = to


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the least item that the pairs reach."""
    parent = np.arange(n)
    for u, v in pairs:
        while True:
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            a, b = parent[u], parent[v]
            if not (apart := a != b).any():
                break
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    while (up := parent[parent]).tobytes() != parent.tobytes():
        parent = up
    return parent


def words_of(column: pa.Array) -> np.ndarray:
    """(n, 64-bit words) of fingerprints that are longs or binary of equal lengths."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1).astype(np.uint64)


def linker(radius: int, fp_type: str):
    """A map over rows (fp, keys ...) sorted by their keys: links (hi, lo) that span the near fingerprints of each key."""
    schema = pa.schema([(c, pa.int64() if fp_type == "long" else pa.binary()) for c in ("hi", "lo")])

    def links(table: pa.Table, keys: np.ndarray) -> pa.RecordBatch:
        fps = words_of(table.column(0).combine_chunks())
        root = spanning(len(fps), near_pairs(fps, np.cumsum(keys), radius))
        moved = np.flatnonzero(root != np.arange(len(fps)))
        a, b = (table.column(0).take(pa.array(x)).combine_chunks() for x in (moved, root[moved]))
        return record_batch(schema, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            new = starts(held)
            cut = int(np.flatnonzero(new)[-1]) if len(new) else 0  # the last key may go on in the next batch
            if cut:
                yield links(held.slice(0, cut), new[:cut])
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield links(held, starts(held))

    def starts(table: pa.Table) -> np.ndarray:
        """Where a row's keys differ from those of the row before; the first row starts a key."""
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in table.columns[1:]:
            x = c.to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return new

    return run


def masks(blocks: int, radius: int) -> list[int]:
    """Bit masks, as signed longs, of every choice of blocks - radius blocks out of `blocks`."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(block, blocks - radius)]


def banded(rows: DataFrame, chosen: list[int], band: str, key: str) -> DataFrame:
    """rows, once for each mask, with the number of the mask and the bits of fp under it."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(chosen)])).alias("k")
    return rows.select("*", each).select(*rows.columns, F.col("k.band").alias(band), F.col("k.key").alias(key))


def large_keys(keyed: DataFrame, by: list[str], chunk: int) -> DataFrame:
    """The keys of about `chunk` rows or more, with their number of rows, from the rows of one fingerprint in COUNTED."""
    some = keyed.filter(F.pmod(F.xxhash64("fp"), F.lit(COUNTED)) == 0) if chunk >= 64 * COUNTED else keyed
    times = COUNTED if chunk >= 64 * COUNTED else 1
    return materialize(some.groupBy(*by).agg((F.count("*") * times).alias("count")).filter(F.col("count") > chunk), "large")


def dealt(keyed: DataFrame, by: list[str], large: DataFrame, chunk: int) -> DataFrame:
    """(fp, by ..., lo, hi): rows of large keys as pairs of chunks, any two of a key in one group at least; all others once."""
    if large.isEmpty():
        return keyed.withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    chunks = F.coalesce(F.ceil(F.col("count") / chunk), F.lit(1)).cast("int")
    sized = keyed.join(large, by, "left").withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    paired = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return paired.select("fp", *by, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def compared(rows: DataFrame, by: list[str], radius: int) -> DataFrame:
    fp_type = dict(rows.dtypes)["fp"].replace("bigint", "long")
    by = [*by, "lo", "hi"]
    return rows.select("fp", *by).repartition(*by).sortWithinPartitions(*by).mapInArrow(linker(radius, fp_type), f"hi {fp_type}, lo {fp_type}")


def near_links(distinct: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Links that connect all fingerprints (column fp, long, no repeats) within the radius of each other.

    The number of blocks follows the number of fingerprints, so that a key has
    about 2,000 of them or fewer; every choice finds every pair. The
    fingerprints of keys with more than `chunk` get keys of more, smaller
    blocks inside them; what is still too large is dealt out as pairs of chunks.
    """
    n = distinct.count()
    blocks = next((b for b in range(radius + 1, radius + 5) if n < 2000 << (64 * (b - radius) // b)), radius + 5)
    by = ["band", "key"]
    keyed = banded(distinct.select("fp"), masks(blocks, radius), *by)
    large = large_keys(keyed, by, chunk)
    if large.isEmpty():
        return compared(dealt(keyed, by, large, chunk), by, radius)
    few = keyed.join(large.select(by), by, "left_anti").withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    finer = ["band", "key", "band2", "key2"]
    many = banded(keyed.join(large.select(by), by, "left_semi"), masks(blocks + 2, radius), *finer[2:])
    rest = dealt(many, finer, large_keys(many, finer, chunk), chunk)
    return compared(few, by, radius).union(compared(rest, finer, radius))


def weakest(margin: np.ndarray, bits: int, weak: int) -> np.ndarray:
    """(rows, blocks, weak): in each block of `bits` bits the places of those nearest to a draw."""
    blocks = margin.shape[1] // bits
    size = np.abs(margin[:, : blocks * bits]).reshape(len(margin), blocks, bits)
    return np.argsort(size, axis=2, kind="stable")[:, :, :weak].astype(np.uint8)


def wide_fingerprints(docs: DataFrame, h: str, width: int, bits: int, weak: int) -> DataFrame:
    """(least, h, fp, weak) for every row of docs (doc_id, text, and a row hash named by `h`).

    fp: 128 bits, those of the shingles' hashes and of a bijection of them;
    weak: places of the weakest bits by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            hashes, sizes = hashes_of(texts, width)
            both = np.concatenate([margins(x, sizes) for x in (hashes, mixed(hashes))], axis=1)
            places = weakest(both, bits, weak)
            yield record_batch(_WIDE, part.column(0), part.column(1), [x.tobytes() for x in packed(both)], [x.tobytes() for x in places])

    narrow = docs.select(F.col("doc_id").cast("long").alias("least"), F.col(h).alias("h"), "text")
    return narrow.mapInArrow(run, "least long, h binary, fp binary, weak binary")


def probes(distinct: DataFrame, bits: int, weak: int) -> DataFrame:
    """(fp, band, key): for each block of a fingerprint its bits, with every subset of its weakest bits flipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n = batch.num_rows
                bytes_ = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(n, -1)
                each = np.unpackbits(bytes_, axis=1, bitorder="little")
                blocks = each.shape[1] // bits
                value = each[:, : blocks * bits].reshape(n, blocks, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                places = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, blocks, weak)
                flips = np.zeros((n, blocks, 1), np.int64)
                for k in range(weak):
                    flips = np.concatenate([flips, flips | (1 << places[:, :, k : k + 1].astype(np.int64))], axis=2)
                keys = (value[:, :, None] ^ flips).ravel()
                per = blocks << weak
                band = np.tile(np.repeat(np.arange(blocks, dtype=np.int32), 1 << weak), n)
                yield record_batch(_KEYED, batch.column(0).take(pa.array(np.repeat(np.arange(n), per))), band, keys)

    return distinct.select("fp", "weak").mapInArrow(run, "fp binary, band int, key long")


#: Bits of a block and how many of its weakest bits are flipped, at any number of rows.
BLOCK_BITS, WEAK_BITS = 20, 3
#: Row keys that are broadcast, at most; more meet their rows by shuffle.
BROADCAST = 200_000


def wide_links(distinct: DataFrame, bits: int, weak: int, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Links between 128-bit fingerprints (columns fp, weak) that share a probed key and lie within the radius."""
    by = ["band", "key"]
    keyed = probes(distinct, bits, weak)
    return compared(dealt(keyed, by, large_keys(keyed, by, chunk), chunk), by, radius)


def components(links: DataFrame) -> DataFrame:
    """(node, root): every linked node and the least node that it reaches, itself included. Nodes: longs or binary.

    Alternates large-star and small-star steps on tables of the shared folder;
    minima are combined before each shuffle and reach the links of a hub by
    broadcast (`joined_by`), so a hub's links never meet in one group.
    """

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()

    ordered = links.filter("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
    edges = materialize(ordered.distinct(), "edges")
    before = mark(edges)
    while before[0]:
        both = edges.select("hi", "lo").union(edges.select(F.col("lo"), F.col("hi"))).toDF("u", "v")
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = materialize(joined_by(both, least, "u", "n", 2 * before[0]).filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        low = materialize(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), "low")
        small = joined_by(large, low, "hi", "n", large.count()).filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = materialize(small.union(low.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        if (after := mark(edges)) == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select(F.col("lo"), F.col("lo")).distinct())


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text; other columns are ignored).

    Fingerprints within `radius` bits are linked; component_id is the least
    doc_id reachable over links. Null texts count as empty, repeated rows stay,
    a null doc_id keeps its row and never is the least unless the component has
    no other, and an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, width), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = materialize(components(near_links(distinct.select("fp"), radius)), "roots").withColumnRenamed("node", "fp")
    linked = materialize(roots.join(distinct.select("fp", "least"), "fp"), "linked")
    whole = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints")), "classes")
    classes = joined_by(linked, whole, "root", "prints", linked.count()).select("fp", "component_id")
    by_print = materialize(distinct.join(classes, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"), "by_print")
    return joined_by(prints, by_print, "fp", "n", prints.count()).select("doc_id", "fp", "component_id")


def row_key(docs: DataFrame) -> Column:
    """SHA-256 of a row as JSON: all columns, nulls where they stand, times to the microsecond."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return F.unhex(F.sha2(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false", "timestampFormat": stamp + "XXX", "timestampNTZFormat": stamp}), 256))


def keep_one(docs: DataFrame, width: int = 5, radius: int = 24) -> DataFrame:
    """One row, all columns, of each group of near-duplicates: the one of least (doc_id, row key), null ids last.

    128-bit fingerprints of shingles of `width` words link within `radius`
    bits where they share a probed key; texts whose shingle sets are similar to
    J differ in 128 / pi * acos(2 J / (1 + J)) bits on average, 19 at 0.8. Null
    texts count as empty, and texts without words are copies of each other.
    Rows are told apart by all their columns and by where nulls stand: rows
    that share a doc_id with other texts are judged each on its own, rows that
    repeat wholly are copies. An empty table gives an empty result.
    """
    h = fresh(docs, "row_key")
    hashed = docs.withColumn(h, row_key(docs))
    prints = materialize(wide_fingerprints(hashed, h, width, BLOCK_BITS, WEAK_BITS), "prints")
    # all rows of one print are copies: the least of them stands for it
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "h")).alias("row")
    distinct = materialize(prints.groupBy("fp", "weak").agg(first), "distinct")
    roots = materialize(components(wide_links(distinct, BLOCK_BITS, WEAK_BITS, radius)), "roots").withColumnRenamed("node", "fp")
    stay = distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("row").alias("row")).select(F.col("row.h").alias("h"), F.lit(True).alias("stays"))
    # rows that go are few beside those that stay, and so are rows that repeat: only these two kinds meet a join
    keys = prints.groupBy("h").agg(F.count("*").alias("n")).join(stay.distinct(), "h", "left")
    odd = materialize(keys.filter("stays IS NULL OR n > 1").select(F.col("h").alias(h), F.col("stays").isNotNull().alias("stays")), "odd")
    few = odd.count() <= BROADCAST
    known = F.broadcast(odd) if few else odd
    single = hashed.join(known, h, "left_anti")
    again = hashed.join(known.filter("stays"), h, "left_semi").dropDuplicates([h])
    return single.unionByName(again).drop(h)
