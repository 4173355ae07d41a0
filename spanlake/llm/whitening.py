"""Embedding whitening by incremental eigendecomposition.

Every partition keeps the spectrum of its centred scatter matrix and takes each
row on as a rank-one update: the secular equation gives the new eigenvalues
between the old ones, entries without weight and equal eigenvalues are deflated
first, and weights that are recomputed from the roots keep the eigenvectors
orthogonal. Two spectra meet by as many rank-one updates as one of them has
eigenvalues, and one for the distance of the means; they are folded by eights.
The basis so found is refined by one Rayleigh-Ritz step: the covariance is
summed over all rows in that basis, by partition and again by eights, and only
that matrix of fixed size is diagonalised.

Vectors are scaled to whole numbers first, so that the count, the sums and each
row's deviation are exact; what enters products is centred by the exact mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, record_batch

#: Components that are returned, at most.
COMPONENTS = 32
#: Longest vector: matrices of so many rows and columns are broadcast and sent to the driver (32 MiB).
DIMENSIONS = 2048
#: Spectra and sums that meet in one group.
FAN = 8
#: Rows that one product takes.
ROWS = 4096
#: Steps of the root finder; it ends by itself long before.
STEPS = 80

_EPS = np.finfo(float).eps


def roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(d_j - root_i as a matrix [i, j], roots) of 1 + sum of w_j / (d_j - x), for ascending d and weights w > 0.

    Each root lies between two poles, the last between the last pole and that
    plus all weights. It is sought as a distance from the nearer pole: the two
    poles at hand are kept, the rest is matched in value and slope, and halving
    takes over where that leaves the interval.
    """
    m, all_w = len(d), w.sum()
    right = np.r_[d[1:], d[-1] + all_w]
    gap = right - d
    at_middle = 1 + (w / (d - (d + gap / 2)[:, None])).sum(axis=1)
    from_left = at_middle >= 0
    from_left[-1] = True
    origin = np.where(from_left, d, right)
    delta = d - origin[:, None]
    lo, hi = np.where(from_left, 0, -gap / 2), np.where(from_left, gap / 2, 0)
    hi[-1] = all_w
    own, after = d - origin, right - origin
    below = np.tri(m)
    above = 1 - below
    x, done = (lo + hi) / 2, np.zeros(m, bool)
    for _ in range(STEPS):
        terms = w / (delta - x[:, None])
        slopes = terms / (delta - x[:, None])
        psi, dpsi = (terms * below).sum(axis=1), (slopes * below).sum(axis=1)
        phi, dphi = (terms * above).sum(axis=1), (slopes * above).sum(axis=1)
        f = 1 + psi + phi
        done |= np.abs(f) <= 4 * _EPS * m * (1 - psi + phi)
        if done.all():
            break
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        p, q = own - x, after - x
        c, a, b = f - p * dpsi - q * dphi, (p + q) * f - p * q * (dpsi + dphi), p * q * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(all="ignore"):
            step = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
            step[-1] = p[-1] + p[-1] ** 2 * dpsi[-1] / (f[-1] - p[-1] * dpsi[-1])
        new = x + step
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        done |= new == x
        x = np.where(done, x, new)
    return delta - x[:, None], origin + x


class Spectrum:
    """Count, mean and the eigenvalues (ascending) and eigenvectors (columns) of the centred scatter matrix."""

    def __init__(self, size: int):
        self.n, self.mean = 0, np.zeros(size)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def update(self, v: np.ndarray) -> None:
        """Add v v' to the matrix."""
        z = v @ self.vectors
        norm2 = float(z @ z)
        if norm2 == 0:
            return
        tolerance = 8 * _EPS * max(self.values[-1], norm2)
        close = np.diff(self.values) <= tolerance
        if close.any():  # equal eigenvalues: turn their vectors so that one alone has weight
            ends = np.flatnonzero(~np.r_[close, False])
            begins = np.r_[0, ends[:-1] + 1]
            for a, b in zip(begins[ends > begins], ends[ends > begins] + 1, strict=True):
                size = np.linalg.norm(z[a:b])
                if size:
                    u = z[a:b] / size
                    u[-1] += 1 if u[-1] >= 0 else -1
                    turned = self.vectors[:, a:b] - np.outer(self.vectors[:, a:b] @ u, 2 / (u @ u) * u)
                    self.vectors[:, a:b], weight = turned, z[b - 1]
                    z[a:b] = 0
                    z[b - 1] = -size if weight >= 0 else size
                self.values[a:b] = self.values[b - 1]
        live = np.flatnonzero(np.abs(z) * np.sqrt(norm2) > tolerance)
        if not len(live):
            return
        d, z = self.values[live], z[live]
        away, new = roots(d, z * z)
        # each root's distance from pole j over that of the pole next to it, on the side away from j
        next_to = np.where(np.tri(len(d), k=-1, dtype=bool).T, d[:, None], np.r_[d[1:], d[-1]][:, None]) - d
        next_to[-1] = 1
        weight = np.sqrt(np.maximum((-away / next_to).prod(axis=0), 0)) * np.where(z < 0, -1, 1)
        turn = weight / away  # [i, j]: entry j of new vector i
        turn /= np.linalg.norm(turn, axis=1, keepdims=True)
        self.vectors[:, live] = self.vectors[:, live] @ turn.T
        self.values[live] = new
        order = np.argsort(self.values, kind="stable")
        if (np.diff(order) < 0).any():
            self.values, self.vectors = self.values[order], np.ascontiguousarray(self.vectors[:, order])

    def add(self, row: np.ndarray) -> None:
        """Take one row on."""
        off = row - self.mean
        self.n += 1
        self.mean += off / self.n
        if self.n > 1:
            self.update(off * np.sqrt((self.n - 1) / self.n))

    def meet(self, other: Spectrum) -> None:
        """Take all rows of another spectrum on."""
        if other.n == 0:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.update(np.sqrt(value) * vector)
        n, off = self.n + other.n, other.mean - self.mean
        self.update(off * np.sqrt(self.n * other.n / n))
        self.mean += off * (other.n / n)
        self.n = n

    def record(self, part: int) -> pa.RecordBatch:
        return record_batch(_STATE, [part], [self.n], [np.concatenate([self.mean, self.values, self.vectors.ravel()])])

    @staticmethod
    def read(n: int, numbers: np.ndarray, size: int) -> Spectrum:
        out = Spectrum(size)
        out.n, out.mean, out.values, out.vectors = n, numbers[:size].copy(), numbers[size : 2 * size].copy(), numbers[2 * size :].reshape(size, size).copy()
        return out


_STATE = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("numbers", pa.list_(pa.float64()))])
_TOTAL = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])
_STATE_SQL = "part long, n long, numbers array<double>"


def numbers_of(table: pa.Table, k: int) -> np.ndarray:
    column = table["numbers"].combine_chunks()
    return column.slice(k, 1).flatten().to_numpy(zero_copy_only=False)


def folded(parts: DataFrame, meet) -> tuple[int, np.ndarray] | None:
    """(n, numbers) of all parts met by eights: meet takes a table of parts and gives (n, numbers)."""

    def group(table: pa.Table) -> pa.Table:
        order = table["part"].combine_chunks().to_numpy(zero_copy_only=False).argsort()
        n, numbers = meet(table.take(pa.array(order)))
        part = int(table["part"][0].as_py()) // FAN
        return pa.Table.from_batches([record_batch(_STATE, [part], [n], [numbers])])

    parts = materialize(parts, "parts")
    while parts.count() > 1:
        parts = materialize(parts.groupBy(F.expr(f"part div {FAN}").alias("of")).applyInArrow(group, _STATE_SQL), "parts")
    found = parts.toArrow()
    return (found["n"][0].as_py(), numbers_of(found, 0)) if found.num_rows else None


def added(table: pa.Table) -> tuple[int, np.ndarray]:
    return sum(table["n"].to_pylist()), np.sum([numbers_of(table, k) for k in range(table.num_rows)], axis=0)


def matrix(column: pa.Array, size: int, fill: int) -> np.ndarray:
    """(rows, size) of whole numbers; what shorter vectors lack is `fill`."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.full((len(lengths), size), fill, np.int64)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


@dataclass(frozen=True)
class Whitening:
    """What the fit found: exact count and sums, unit components (columns) by falling eigenvalue, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    fill: int

    @property
    def origin(self) -> np.ndarray:
        """Whole numbers next to the mean."""
        return np.array([round(Fraction(s, self.n)) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """The mean less the origin, in full precision."""
        return np.array([float(Fraction(s, self.n) - int(o)) for s, o in zip(self.sums, self.origin, strict=True)])

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.origin) - self.rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum of (n x - S)^2 of each row, exact; null beyond 38 digits."""
        left = np.array([s - self.n * int(o) for s, o in zip(self.sums, self.origin, strict=True)], object)
        off = x - self.origin
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * off - left.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum(int(t) ** 2 for t in row) for row in self.n * off.astype(object) - left]
        return [t if t < 10**38 else None for t in exact]


def scaled(vectors: DataFrame, scale: int, shift: int, row_id: str, vector: str) -> DataFrame:
    """(id, x): floor(scale * entry) + shift of the vectors that have finite entries only."""
    entry: Column = vectors[vector]
    fine = F.forall(entry, lambda c: F.coalesce(F.abs(c.cast("double")) * scale < float(1 << 53), F.lit(False)))
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)
    return vectors.filter(entry.isNotNull() & fine).select(vectors[row_id].alias("id"), x.alias("x"))


def totals(rows: DataFrame, size: int, fill: int) -> tuple[int, list[int]]:
    """Exact count and sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), size, fill)
            high, low = (x >> 26).sum(axis=0).tolist(), (x & ((1 << 26) - 1)).sum(axis=0).tolist()
            yield record_batch(_TOTAL, [len(x)], [[Decimal((a << 26) + b) for a, b in zip(high, low, strict=True)]])

    each = rows.select("x").mapInArrow(run, "n long, sums array<decimal(38,0)>")
    by = each.select("n", F.posexplode("sums")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).orderBy("pos").collect()
    return (by[0]["n"], [int(r["s"]) for r in by]) if by else (0, [])


def fit_rows(rows: DataFrame, fill: int, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows (id, x); None where no component has any variance."""
    size = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if size > DIMENSIONS:
        raise ValueError(f"vectors of {size} entries; at most {DIMENSIONS} are taken")
    if not size:
        return None
    n, sums = totals(rows, size, fill)
    plain = Whitening(n, sums, np.eye(size), np.ones(size), 1.0, fill)

    def spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Spectrum(size)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for row in plain.centred(matrix(batch.column(0).slice(at, ROWS), size, fill)):
                    found.add(row)
        if found.n:
            yield found.record(TaskContext.get().partitionId())

    def met(table: pa.Table) -> tuple[int, np.ndarray]:
        first, *others = (Spectrum.read(table["n"][k].as_py(), numbers_of(table, k), size) for k in range(table.num_rows))
        for other in others:
            first.meet(other)
        return first.n, np.concatenate([first.mean, first.values, first.vectors.ravel()])

    _, numbers = folded(rows.select("x").mapInArrow(spectra, _STATE_SQL), met)
    basis = np.linalg.qr(Spectrum.read(n, numbers, size).vectors)[0]
    held = rows.sparkSession.sparkContext.broadcast(basis)

    def ritz(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from products(batches, lambda batch: plain.centred(matrix(batch.column(0), size, fill)) @ held.value)

    _, numbers = folded(rows.select("x").mapInArrow(ritz, _STATE_SQL), added)
    values, turn = np.linalg.eigh(numbers[size:].reshape(size, size) / n)
    values, turn = values[::-1], turn[:, ::-1]
    trace = float(values.sum())
    kept = int((values[:most] > size * _EPS * trace).sum())
    return Whitening(n, sums, basis @ turn[:, :kept], values[:kept], trace, fill) if kept else None


def products(batches: Iterator[pa.RecordBatch], rows_of) -> Iterator[pa.RecordBatch]:
    """One part with the sums and the products' sums of the rows that rows_of makes of slices of batches."""
    n, sums, square = 0, 0.0, 0.0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            y = rows_of(batch.slice(at, ROWS))
            n, sums, square = n + len(y), sums + y.sum(axis=0), square + y.T @ y
    if n:
        yield record_batch(_STATE, [TaskContext.get().partitionId()], [n], [np.concatenate([sums, square.ravel()])])


def whitened_rows(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened) of rows (id, x); whitened holds one number a component."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, m = batch.slice(at, ROWS), held.value
                x = matrix(part.column(1), len(m.sums), m.fill)
                exact = [None if t is None else Decimal(t) for t in m.deviations(x)]
                schema = pa.schema([("id", part.schema.field(0).type), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])
                yield record_batch(schema, part.column(0), exact, list(m.whiten(x)))

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame) -> float:
    """The largest entry, by size, of the covariance of the column `whitened` minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from products(batches, lambda batch: matrix(batch.column(0), len(batch.column(0)[0]), 0))

    n, numbers = folded(whitened.select("whitened").mapInArrow(run, _STATE_SQL), added)
    size = int((np.sqrt(4 * len(numbers) + 1) - 1) / 2 + 0.5)
    mean = numbers[:size] / n
    return float(np.abs(numbers[size:].reshape(size, size) / n - np.outer(mean, mean) - np.eye(size)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = 64, shift: int = 1_000_000, row_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """(rows (id, deviation, whitened), the fit) of all vectors, which are read as floor(scale * entry) + shift.

    Rows with a null vector or an entry that is null, not finite, or 2^53 or
    more once scaled take no part. Shorter vectors are filled up with zeros.
    Repeated rows and ids, null ids included, count and stay. Components
    without variance (to double precision) are left out; without any, as with
    an empty table or equal vectors alone, no row is returned. Other columns
    are ignored.
    """
    rows = materialize(scaled(vectors, scale, shift, row_id, vector), "scaled")
    model = fit_rows(rows, shift, components)
    if model is None:
        kind = rows.schema["id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"id {kind}, deviation decimal(38,0), whitened array<double>"), None
    return materialize(whitened_rows(rows, model), "whitened"), model
