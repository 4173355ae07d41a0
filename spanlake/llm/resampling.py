"""Importance resampling with hashed n-gram generative models.

Two bag models over hashed word unigrams and bigrams, one of target text and
one of all raw text, give each document the log ratio of its probabilities;
Gumbel noise, a function of the document, turns the k greatest sums into a
sample without replacement in proportion to the ratios.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, record_batch
from .language_id import mixed

BUCKETS = 10_000
#: Target documents, at most: those of least hash.
TARGET_SAMPLE = 20_000
#: Share of the rows that the sample has.
SHARE = 0.9
#: Cells that a round of the search for the k-th key counts in, and rows below which the rest is ranked.
CELLS, FEW = 4096, 5000

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_FACTOR = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor modulo 2**64 and of its inverse, n of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 21)
        for name, factor in (("up", _FACTOR), ("down", pow(_FACTOR, -1, 1 << 64))):
            _powers[name] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, factor, np.uint64)], dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word in order; A-Z lower-cased. All bytes of a batch are hashed in one sweep."""
    data = [t.encode("utf-8", "surrogatepass").lower() + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8)
    blank = _BLANK[raw]
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    end = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    up, down = powers(len(raw))
    sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)]
    h = mixed((sums[end] - sums[start]) * down[start])
    edges = np.cumsum([len(x) for x in data])
    return h, np.searchsorted(edges, start, side="right")


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every unigram and bigram."""
    h, text = word_hashes(texts)
    same = text[1:] == text[:-1]
    two = mixed(h[:-1][same] * np.uint64(3) + h[1:][same])
    return (np.concatenate([h, two]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([text, text[:-1][same]])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts: BUCKETS numbers, summed by Spark from one vector per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, texts in pieces(batches, "text"):
            total += np.bincount(gram_buckets(texts)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield record_batch(pa.schema([("bucket", pa.int32()), ("n", pa.int64())]), some.astype(np.int32), total[some])

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw): target from at most TARGET_SAMPLE documents, raw from all."""
    ids = target_ids.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_SAMPLE)
    target = bucket_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi"))
    raw = bucket_counts(docs)
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def cut_at(rows: DataFrame, column: str, k: int) -> tuple[float | int, int]:
    """(the k-th greatest value of a column without nulls, how many rows of that value are among the k); 0 < k <= rows.

    Values are counted in ever narrower cells; only the values of the last cell are ranked.
    """
    above = 0
    low, high = rows.agg(F.min(column), F.max(column)).first()
    at = F.col(column).cast("double")
    while True:
        width = (float(high) - float(low)) / CELLS
        cell = F.least(F.lit(CELLS - 1), F.floor((at - float(low)) / width)) if width > 0 else F.lit(0)
        inside = rows.filter(F.col(column).between(low, high))
        counts = dict(inside.groupBy(cell.cast("int").alias("cell")).count().collect())
        for c in sorted(counts, reverse=True):
            if above + counts[c] >= k:
                break
            above += counts[c]
        inside = inside.filter(cell == c)
        now = inside.agg(F.min(column), F.max(column)).first()
        if counts[c] <= FEW or now[0] == now[1] or (now[0], now[1]) == (low, high):  # few rows, or few values
            for value, n in sorted(inside.groupBy(column).count().collect(), reverse=True):
                if above + n >= k:
                    return value, k - above
                above += n
        low, high = now


def greatest(rows: DataFrame, k: int) -> DataFrame:
    """rows (doc_id, key, row, ...) with kept: whether the row is among the k of greatest key; ties by doc_id, nulls last, then by row.

    row: any unique number. Exactly k rows are kept, or all where there are fewer.
    """
    n = rows.count()
    if k <= 0 or k >= n:
        return rows.withColumn("kept", F.lit(k > 0))
    kept, tied = F.lit(False), F.lit(True)
    late = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(-(1 << 63)))  # falls as doc_id grows
    ranked = rows.withColumns({"late_": late, "back_": -F.col("row")})
    for column in ("key", "late_", "back_"):
        edge, over = cut_at(ranked.filter(tied), column, k)
        kept = kept | (tied & (F.col(column) > edge))
        tied = tied & (F.col(column) == edge)
        if column == "back_" or ranked.filter(tied).count() == over:
            break
        k = over
    return ranked.withColumn("kept", kept | tied).drop("late_", "back_")


def resample(docs: DataFrame, target_ids: DataFrame, share: float = SHARE, seed: int = 11) -> DataFrame:
    """(doc_id, log_ratio, key, kept) for every row of docs (doc_id, text; other columns are ignored).

    kept marks ceil(share x rows) rows, exactly. Null and empty texts have log
    ratio 0; rows that repeat share a key, and ties at the last key are broken
    by doc_id, then arbitrarily; an empty table gives an empty result; without
    target text all ratios are 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, target_ids))
    schema = pa.schema([("doc_id", pa.int64()), ("log_ratio", pa.float64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            bucket, text = gram_buckets(texts)
            sums = np.bincount(text, weights=held.value[bucket], minlength=len(texts))
            yield record_batch(schema, part.column(0), sums, part.column(2))

    mapped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")).mapInArrow(run, "doc_id long, log_ratio double, h long")
    uniform = (F.shiftrightunsigned("h", 11).cast("double") + 0.5) / float(1 << 53)
    keyed = mapped.select("doc_id", "log_ratio", (F.col("log_ratio") - F.log(-F.log(uniform))).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(keyed, "keys")
    return greatest(rows, int(np.ceil(share * rows.count()))).drop("row")
