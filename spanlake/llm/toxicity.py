"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Spark counts, over a bounded sample of labelled documents, in how many toxic
and other documents each hashed n-gram occurs; the log ratio of the smoothed
shares scales the n-gram's feature. The n-grams that tell most enter a logistic
regression on the same sample, whose weights times the ratios form one table of
bucket weights. Scoring maps Arrow batches with that table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, pieces, record_batch
from .language_id import mixed, symbols

#: Lengths of n-grams; hash buckets as a power of two.
LENGTHS, BITS = (3, 4, 5, 6), 20
#: Documents of either label that the classifier is fitted on, at most: those of least hash.
TOXIC_SAMPLE, OTHER_SAMPLE = 4096, 8192
#: n-grams that enter the regression, and in how many documents one must occur. Measured on held-out documents, more
#: n-grams than these catch fewer toxic texts and flag more clean ones (figures in the README).
KEPT, LEAST = 1024, 5
SMOOTHING, PENALTY, STEPS = 1.0, 1.0, 400
THRESHOLD = 0.3


def buckets(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of the n-grams of each length, inside texts."""
    for n in LENGTHS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        key = np.full(m, n, np.uint64)
        for i in range(n):
            key = key * np.uint64(0x100000001B3) + codes[i : i + m]
        inside = owner[n - 1 :] == owner[:m]
        yield (mixed(key[inside]) >> np.uint64(64 - BITS)).astype(np.int64), owner[:m][inside]


def present(texts: list[str], place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs without repeats, sorted; with `place` only buckets whose place is not negative, and as that place."""
    codes, owner = symbols(texts)
    found = []
    for bucket, text in buckets(codes, owner):
        if place is not None:
            at = place[bucket]
            bucket, text = at[at >= 0], text[at >= 0]
        found.append((text.astype(np.int64) << BITS) | bucket)
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Model:
    """Score of a text: 1 / (1 + exp(-(bias + sum of weights of the buckets present)))."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float

    def places(self) -> np.ndarray:
        place = np.full(1 << BITS, -1, np.int32)
        place[self.bucket] = np.arange(len(self.bucket))
        return place

    def score(self, texts: list[str], place: np.ndarray) -> np.ndarray:
        text, at = present(texts, place)
        margin = self.bias + np.bincount(text, weights=self.weight[at], minlength=len(texts)) if len(self.bucket) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def regression(row: np.ndarray, at: np.ndarray, toxic: np.ndarray, ratio: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on features `ratio` where present, by gradient steps with momentum.

    share: share of toxic documents among all labelled ones; samples weigh so as
    to restore it. The penalty draws weights to their mean, where the ratios
    alone decide.
    """
    n, y = len(toxic), toxic.astype(float)
    each = np.where(toxic, share / max(1, toxic.sum()), (1 - share) / max(1, (~toxic).sum()))
    w, b, m, v = np.ones(len(ratio)) * 0.1, 0.0, np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(row, weights=(w * ratio)[at], minlength=n)
        error = each * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.r_[np.bincount(at, weights=error[row], minlength=len(ratio)) * ratio + PENALTY * (w - w.mean()) / len(ratio), error.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w * ratio, float(b)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of labels (doc_id, toxic) that are not held out; rows with a null label or doc_id are ignored.

    Fitted on whole texts of at most TOXIC_SAMPLE and OTHER_SAMPLE documents. A
    doc_id with several labels is toxic if any of them says so; one with
    several texts counts once, with the least of them. Without documents of
    either kind every score is the share of toxic ones.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.bool_or(F.col("toxic") != 0).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = counts.get(True, 0) / max(1, sum(counts.values()))
    prior = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    if len(counts) < 2:
        return prior
    drawn = [known.filter("toxic" if yes else "NOT toxic").orderBy(F.xxhash64("id"), "id").limit(most) for yes, most in ((True, TOXIC_SAMPLE), (False, OTHER_SAMPLE))]
    # at most TOXIC_SAMPLE + OTHER_SAMPLE ids: a bounded broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(drawn[0].union(drawn[1])), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text")
    sample = materialize(sample, "sample")
    count_schema = pa.schema([("bucket", pa.int32()), ("toxic", pa.int64()), ("other", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, 1 << BITS), np.int64)
        for part, texts in pieces(batches, "text"):
            text, bucket = present(texts)
            yes = np.array(part.column(0).to_pylist(), bool)[text]
            both[0] += np.bincount(bucket[yes], minlength=1 << BITS)
            both[1] += np.bincount(bucket[~yes], minlength=1 << BITS)
        some = np.flatnonzero(both.any(axis=0))
        for at in range(0, len(some), 1 << 16):
            s = some[at : at + (1 << 16)]
            yield record_batch(count_schema, s.astype(np.int32), both[0][s], both[1][s])

    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return prior
    summed = sample.mapInArrow(count, "bucket int, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).filter(F.col("t") + F.col("o") >= LEAST)
    p, q = (F.col("t") + SMOOTHING) / (n[True] + 2 * SMOOTHING), (F.col("o") + SMOOTHING) / (n[False] + 2 * SMOOTHING)
    ratio = F.log(p) - F.log(q)
    best = summed.select("bucket", ratio.alias("ratio"), (ratio * (p - q)).alias("tells")).orderBy(F.desc("tells"), "bucket").limit(KEPT).collect()
    if not best:
        return prior
    bucket, ratios = np.array([r["bucket"] for r in best], np.int64), np.array([r["ratio"] for r in best])
    place = Model(bucket, ratios, 0.0).places()
    held = docs.sparkSession.sparkContext.broadcast(place)
    kept_schema = pa.schema([("toxic", pa.bool_()), ("at", pa.list_(pa.int32()))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            text, at = present(texts, held.value)
            ends = np.searchsorted(text, np.arange(1, len(texts)))
            yield record_batch(kept_schema, part.column(0), [x.tolist() for x in np.split(at, ends)])

    rows = sample.mapInArrow(features, "toxic boolean, at array<int>").toArrow()
    each = [x or [] for x in rows["at"].to_pylist()]
    row = np.repeat(np.arange(len(each)), [len(x) for x in each])
    at = np.fromiter((i for x in each for i in x), np.int64, len(row))
    weight, bias = regression(row, at, np.array(rows["toxic"].to_pylist(), bool), ratios, share)
    return Model(bucket, weight, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs (doc_id, text; other columns are ignored), score from 0 to 1.

    Null and empty texts score as a text without n-grams; rows repeat as given; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast((model, model.places()))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = held.value
        for part, texts in pieces(batches, "text"):
            yield record_batch(schema, part.column(0), own.score(texts, place))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
