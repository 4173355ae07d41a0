"""Hard-negative mining with bounds from spanning trees of anchors.

Anchors of one label are joined to a minimum spanning tree by Euclidean
distance, in blocks of bounded size. A candidate's score at the root is
computed; at any child it differs from that at the parent by at most the edge's
length times the candidate's norm, so each candidate has an interval at every
anchor. Only candidates whose interval meets what is sought there are scored
again, which makes their interval a point for the anchors below: first those
that may be among an anchor's best rows of its own label, its positives, then
those of other labels that may lie in the window of one of these.

Each block of anchors is a query set that is broadcast and meets all candidates
where they stand; a task keeps the best few rows of each anchor, which are
ranked by a window afterwards. All scores are exact whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, record_batch
from .whitening import matrix

#: Anchors of a block, most; and most bytes of their vectors.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Longest vector, and the limit of a scaled entry: no sum leaves 53 bits, so scores are exact in doubles.
DIMENSIONS, ENTRY = 4096, 1 << 20
#: Candidates that are bounded at a time.
ROWS = 1024
#: What rounding can take from a bound, relative to it.
SLACK = 1e-9

_TREES = pa.schema([("tree", pa.int64()), ("label", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.list_(pa.int64())), ("parents", pa.list_(pa.int32())), ("edges", pa.list_(pa.float64()))])
_FOUND = pa.schema([("anchor", pa.int32()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "anchor int, place int, id long, score long"


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parents, edges): rows in an order in which each follows its parent (a place in that order; -1 at the root), and its distance."""
    x = vectors.astype(float)
    n = len(x)
    order, up, best = np.zeros(n, np.int64), np.full(n, -1), np.full(n, np.inf)
    place, parents, left = np.zeros(n, np.int64), np.full(n, -1, np.int32), np.ones(n, bool)
    at = 0
    for k in range(n):
        order[k], place[at], left[at] = at, k, False
        if k:
            parents[k] = place[up[at]]
        off = x - x[at]
        distance = np.einsum("ij,ij->i", off, off)
        nearer = left & (distance < best)
        best[nearer], up[nearer] = distance[nearer], at
        if k + 1 < n:
            at = int(np.where(left, best, np.inf).argmin())
    edges = np.zeros(n)
    edges[1:] = np.linalg.norm(x[order[1:]] - x[order[parents[1:]]], axis=1)
    return order, parents, edges


def block_size(size: int) -> int:
    """Anchors of a block, most, for vectors of `size` entries."""
    return max(1, min(BLOCK, BLOCK_BYTES // (8 * size)))


def trees(anchors: DataFrame, size: int) -> DataFrame:
    """One row per tree of at most a block's anchors, all of one label.

    Anchors are dealt by label and the signs of their first entries, so that
    those of a tree are near each other where any are.
    """
    per = block_size(size)
    signs = F.aggregate(F.slice("v", 1, 32), F.lit(0).cast("long"), lambda s, c: s * 2 + (c >= 0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = 0
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            while at < batch.num_rows:
                to = min(batch.num_rows, at + per, at + int(np.searchsorted(labels[at:], labels[at], side="right")))
                own = batch.slice(at, to - at)
                x = matrix(own.column(2), size, 0)
                order, parents, edges = spanning_tree(x)
                ids = own.column(0).to_numpy(zero_copy_only=False)[order]
                yield record_batch(_TREES, [number], [int(labels[at])], [ids], [x[order].ravel()], [parents], [edges])
                number, at = number + 1, to

    dealt = anchors.withColumn("signs", signs)
    dealt = dealt.repartitionByRange(max(1, -(-dealt.count() // per)), "label", "signs", "id").sortWithinPartitions("label", "signs", "id")
    return dealt.select("id", "label", "v").mapInArrow(run, "tree long, label long, ids array<long>, vectors array<long>, parents array<int>, edges array<double>")


@dataclass
class Tree:
    """Anchors of one label: numbers `first` and on in their block, parents before children."""

    first: int
    label: int
    ids: np.ndarray
    vectors: np.ndarray
    parents: np.ndarray
    edges: np.ndarray

    def levels(self) -> list[np.ndarray]:
        depth = np.zeros(len(self.ids), np.int64)
        for k in range(1, len(depth)):
            depth[k] = depth[self.parents[k]] + 1
        return [np.flatnonzero(depth == k) for k in range(depth.max() + 1)]


def blocks(planted: DataFrame, per: int) -> Iterator[list[int]]:
    """Numbers of the trees of each block: trees in a row with at most `per` anchors together."""
    own, total = [], 0
    for tree, n in planted.select("tree", F.size("ids")).orderBy("tree").toLocalIterator():
        if own and total + n > per:
            yield own
            own, total = [], 0
        own, total = [*own, tree], total + n
    if own:
        yield own


def block_of(table: pa.Table, size: int) -> list[Tree]:
    out, first = [], 0
    for r in table.to_pylist():
        ids = np.array(r["ids"], np.int64)
        out.append(Tree(first, r["label"], ids, np.array(r["vectors"], float).reshape(-1, size), np.array(r["parents"]), np.array(r["edges"])))
        first += len(ids)
    return out


@dataclass
class Candidates:
    """Rows of a batch: ids (with `none` where null: these come last among equals), vectors and norms."""

    ids: np.ndarray
    none: np.ndarray
    x: np.ndarray
    norms: np.ndarray

    def only(self, rows: np.ndarray) -> Candidates:
        return Candidates(self.ids[rows], self.none[rows], self.x[rows], self.norms[rows])


class Best:
    """The first `most` rows of each of n lists: by score, falling, then id."""

    def __init__(self, n: int, most: int):
        self.most = most
        self.scores = np.zeros((n, most), np.int64)
        self.ids, self.none, self.size = np.zeros((n, most), np.int64), np.zeros((n, most), bool), np.zeros(n, np.int64)
        self.least = np.full(n, -np.inf)

    def put(self, k: int, scores: np.ndarray, own: Candidates, rows: np.ndarray) -> None:
        m = self.size[k]
        s, i, z = np.r_[self.scores[k, :m], scores], np.r_[self.ids[k, :m], own.ids[rows]], np.r_[self.none[k, :m], own.none[rows]]
        order = np.lexsort((i, z, -s))[: self.most]
        self.size[k] = m = len(order)
        self.scores[k, :m], self.ids[k, :m], self.none[k, :m] = s[order], i[order], z[order]
        if m == self.most:
            self.least[k] = self.scores[k, -1]

    def records(self, places: int) -> Iterator[pa.RecordBatch]:
        k, at = np.nonzero(np.arange(self.most) < self.size[:, None])
        for lo in range(0, len(k), 4096):
            a, b = k[lo : lo + 4096], at[lo : lo + 4096]
            yield record_batch(_FOUND, (a // places).astype(np.int32), (a % places).astype(np.int32), pa.array(self.ids[a, b], mask=self.none[a, b]), self.scores[a, b])


def walk(tree: Tree, own: Candidates, sought, take) -> int:
    """Bound the candidates at every anchor from its parent's bounds, and score those that are sought.

    sought(nodes, lo, hi): which intervals (node, candidate) meet what is
    sought; take(node, scores, rows): new exact scores. Returns how many were
    scored.
    """
    shape = len(tree.ids), len(own.ids)
    lo, hi = np.full(shape, -np.inf), np.full(shape, np.inf)
    scored = 0
    for nodes in tree.levels():
        if tree.parents[nodes[0]] >= 0:
            reach = np.outer(tree.edges[nodes], own.norms) * (1 + SLACK) + SLACK
            lo[nodes], hi[nodes] = lo[tree.parents[nodes]] - reach, hi[tree.parents[nodes]] + reach
            mask = sought(nodes, lo[nodes], hi[nodes])
        else:
            mask = np.ones((len(nodes), shape[1]), bool)
        columns = np.flatnonzero(mask.any(axis=0))
        if not len(columns):
            continue
        scores = (tree.vectors[nodes] @ own.x[columns].T).astype(np.int64)
        for k, node in enumerate(nodes):
            new = mask[k, columns]
            rows, exact = columns[new], scores[k, new]
            lo[node, rows] = hi[node, rows] = exact
            take(node, exact, rows)
            scored += len(rows)
    return scored


def search(rows: DataFrame, trees_: list[Tree], size: int, lists: int, most: int, alike: bool, windows: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(anchor, place, id, score): each task's best rows of every anchor's lists.

    alike: of the anchor's label and another id, else of other labels. windows:
    least and most score of each list (anchors, lists); without, any score.
    """
    n = sum(len(t.ids) for t in trees_)
    low, high = windows if windows else (np.full((n, lists), -np.inf), np.full((n, lists), np.inf))
    held = rows.sparkSession.sparkContext.broadcast((trees_, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_, low, high = held.value
        best = Best(n * lists, most)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, x, labels = part.column(0), matrix(part.column(2), size, 0).astype(float), part.column(1).to_numpy(zero_copy_only=False)
                none = ids.is_null().to_numpy(zero_copy_only=False)
                every = Candidates(ids.fill_null(0).to_numpy(zero_copy_only=False), none, x, np.linalg.norm(x, axis=1))
                for tree in trees_:
                    own = every.only(np.flatnonzero((labels == tree.label) == alike))
                    if len(own.ids):
                        use(tree, own, low, high, best)
        yield from best.records(lists)

    def use(tree: Tree, own: Candidates, low: np.ndarray, high: np.ndarray, best: Best) -> None:
        def floor(numbers: np.ndarray) -> np.ndarray:
            lists_of = numbers[:, None] * lists + np.arange(lists)
            return np.maximum(low[numbers], best.least[lists_of])

        def sought(nodes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            least, top = floor(tree.first + nodes), high[tree.first + nodes]
            mask = np.zeros(lo.shape, bool)
            for p in range(lists):
                mask |= (hi >= least[:, p, None]) & (lo <= top[:, p, None])
            return mask

        def take(node: int, scores: np.ndarray, rows: np.ndarray) -> None:
            number = tree.first + int(node)
            least = floor(np.array([number]))[0]
            for p in range(lists):
                fit = (scores >= least[p]) & (scores <= high[number, p])
                if alike:
                    fit &= (own.ids[rows] != tree.ids[node]) | own.none[rows]
                if fit.any():
                    best.put(number * lists + p, scores[fit], own, rows[fit])

        walk(tree, own, sought, take)

    found = rows.mapInArrow(run, _FOUND_SQL)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def scaled_rows(vectors: DataFrame, scale: int, row_id: str, label: str, vector: str) -> DataFrame:
    """(id, label, v) of rows that take part, rows that repeat wholly once."""
    entry = vectors[vector]
    fine = F.forall(entry, lambda c: F.coalesce(F.abs(c.cast("double")) * scale < float(ENTRY), F.lit(False)))
    v = F.transform(entry, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    kept = vectors.filter(entry.isNotNull() & vectors[label].isNotNull() & fine)
    return kept.select(vectors[row_id].cast("long").alias("id"), vectors[label].cast("long").alias("label"), v.alias("v")).distinct()


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, row_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Entries are read as floor(scale * entry), a score is an inner product.
    Anchors are the rows for which the condition `anchor` on the column `id`
    holds. A positive is one of the first `positives` rows of an anchor's label
    with another id; its negatives are the first `negatives` rows of other
    labels whose score is low to high percent of its own. Higher scores come
    first, equal ones by id, null ids last.

    Rows with a null label or vector, or an entry that is null, not finite or
    2^20 or more once scaled, take no part; shorter vectors are filled up with
    zeros. Rows that repeat wholly count once; rows that share an id alone are
    rows of their own, but no positives of each other. Other columns are
    ignored; an empty table, and one without anchors, gives an empty result.
    """
    rows = materialize(scaled_rows(vectors, scale, row_id, label, vector), "vectors")
    size = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    if size > DIMENSIONS:
        raise ValueError(f"vectors of {size} entries; at most {DIMENSIONS} are taken")
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "negatives")
    planted = materialize(trees(rows.filter(anchor), size), "trees")
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], names).write.parquet(f"{path}/block=-1")
    for block, numbers in enumerate(blocks(planted, block_size(size))):
        own = block_of(planted.filter(F.col("tree").isin(numbers)).toArrow(), size)
        first = materialize(search(rows, own, size, 1, positives, True), "positives")
        ids = np.concatenate([t.ids for t in own])
        # no score lies in an empty list's window
        bounds = np.full((len(ids), positives), np.inf), np.full((len(ids), positives), -np.inf)
        for r in first.toLocalIterator():  # at most `positives` rows for each anchor of the block
            bounds[0][r["anchor"], r["rank"] - 1], bounds[1][r["anchor"], r["rank"] - 1] = -(-low * r["score"] // 100), high * r["score"] // 100
        second = search(rows, own, size, positives, negatives, False, bounds)
        named = spark.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "anchor int, anchor_id long")
        pairs = first.select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = second.join(pairs, ["anchor", "place"]).join(F.broadcast(named), "anchor")
        found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{path}/block={block}")
    return spark.read.schema(names).parquet(path).select(*[c.split()[0] for c in names.split(", ")])
