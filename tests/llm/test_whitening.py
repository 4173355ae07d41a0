"""Whitening against a dense eigendecomposition in numpy; rank-one updates on awkward spectra."""

import math

import numpy as np
import pytest

from spanlake.llm import registry, whitening
from spanlake.llm.whitening import Spectrum


def dense(rows):
    """(n, sums, deviations, eigenvalues falling, components, trace) of whole-number rows."""
    x = np.array(rows, dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviations = [sum(int(t) ** 2 for t in n * r - sums) for r in x]
    c = (n * x - sums).astype(float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return n, sums, deviations, values[::-1], vectors[:, ::-1], values.sum(), c


@pytest.mark.parametrize("kind", ["plain", "repeats", "few", "equal", "one entry", "diagonal", "hot row", "steep"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(400, 24)) * 9)
    x = {"plain": x, "repeats": np.repeat(x[:3], 40, 0), "few": x[:9], "equal": x[:1].repeat(7, 0), "one entry": x[:, :1], "diagonal": np.diag(np.arange(6.0)).repeat(30, 0), "hot row": np.vstack([x[:90], x[:1].repeat(90, 0)]), "steep": x * np.r_[1e7, np.ones(23)]}[kind]
    whole, halves = Spectrum(x.shape[1]), [Spectrum(x.shape[1]) for _ in range(2)]
    for k, row in enumerate(x):
        whole.add(row)
        halves[k % 3 > 0].add(row)
    halves[0].meet(halves[1])
    c = x - x.mean(axis=0)
    c = c.T @ c
    for s in (whole, halves[0]):
        assert s.n == len(x) and np.allclose(s.mean, x.mean(axis=0), rtol=1e-12, atol=1e-12 * np.abs(x).max())
        assert np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < 1e-12
        assert np.abs(s.vectors * s.values @ s.vectors.T - c).max() <= 1e-12 * max(c.max(), 1)
        assert (np.diff(s.values) >= 0).all()


def test_query_equals_dense(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in r["embedding"]] for r in rows]
    n, _, deviations, values, vectors, trace, c = dense(x)
    got = registry.op13_whitening(spark, tiny).toPandas()
    assert len(got) == 32 * len(rows) and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and 0 < got["identity_error"][0] < 1e-10
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in rows]].to_numpy()
    want = c @ vectors[:, :32] / np.sqrt(values[:32])
    signs = np.sign((wide * want).sum(axis=0))
    assert np.abs(wide - want * signs).max() < 1e-8
    assert dict(zip(got["vec_id"], got["deviation"], strict=True)) == {r["vec_id"]: t for r, t in zip(rows, deviations, strict=True)}
    share = got.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(share, values[:32] / trace, rtol=1e-12)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5], 3), (1, [1.0, 2.0, 0.5], 3), (None, [0.0, -1.0, 7.0], 3), (2, None, 3), (3, [1.0, None, 2.0], 3), (4, [nan, 0.0, 0.0], None), (5, [inf, 0.0, 0.0], 1), (6, [3.0], 1), (7, [], 1), (8, [1e300, 0.0, 0.0], 1), (9, [5.5, 1e9, -2.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, deviation int").repartition(4)
    got, fit = whitening.whiten(vectors)
    kept = [r for r in rows if r[0] in (1, None, 6, 7, 9)]
    x = [[math.floor(64 * c) + 1_000_000 for c in [*r[1], 0.0, 0.0, 0.0][:3]] for r in kept]
    n, sums, deviations, values, *_ = dense(x)
    assert fit.n == n == 6 and fit.sums == sums.tolist()
    assert sorted(int(r["deviation"]) for r in got.collect()) == sorted(deviations)
    assert np.allclose(fit.eigenvalues, values[: len(fit.eigenvalues)], rtol=1e-9)
    for none in (vectors.limit(0), vectors.filter("vec_id = 1"), vectors.filter("vec_id = 7"), vectors.filter("vec_id = 2")):
        rows_of_none, no_fit = whitening.whiten(none)
        assert no_fit is None and rows_of_none.collect() == [] and rows_of_none.columns == got.columns
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [0.0] * (whitening.DIMENSIONS + 1))], "vec_id long, embedding array<double>"))


def test_any_partitioning_gives_the_same_fit(spark, tiny):
    vectors = spark.read.parquet(f"{tiny}/embeddings.parquet")
    one, many = (whitening.whiten(vectors.repartition(k))[1] for k in (1, 19))  # 19 parts: two rounds of folding
    assert np.allclose(one.eigenvalues, many.eigenvalues, rtol=1e-11)
    assert np.allclose(np.abs((one.components * many.components).sum(axis=0)), 1, atol=1e-9)
