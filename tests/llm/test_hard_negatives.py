"""Hard negatives against brute force; bounds, trees and blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import hard_negatives
from spanlake.llm.hard_negatives import Candidates, Tree, mine, spanning_tree, walk


def usable(rows):
    out = {}
    for i, label, v in rows:
        if label is None or v is None or any(c is None or not math.isfinite(c) or abs(256 * c) >= 1 << 20 for c in v):
            continue
        out[(i, label, tuple(math.floor(256 * c) for c in v))] = None
    return list(out)


def brute(rows, is_anchor, positives=5, negatives=3):
    rows, out = usable(rows), []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    first = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for a, label, v in rows:
        if a is None or not is_anchor(a):
            continue
        scores = [(dot(v, w), i, own) for i, own, w in rows if i != a or i is None or own != label]
        for ps, p, _ in sorted((s for s in scores if s[2] == label), key=first)[:positives]:
            window = [s for s in scores if s[2] != label and 50 * ps <= 100 * s[0] <= 95 * ps]
            out += [(a, p, k + 1, i, ps, s) for k, (s, i, _) in enumerate(sorted(window, key=first)[:negatives])]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, v int, id string")


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("block", "parts"), [(2048, 1), (5, 4)])
def test_equals_brute_force(spark, monkeypatch, block, parts):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), int(rng.integers(4)), [float(c) for c in np.float32(np.round((centres[i % 6] + rng.normal(size=8) * 0.3) * 4) / 8)]) for i in range(300)]  # coarse entries: many ties
    rows += rows[:20] + [(None, 1, rows[3][2]), (None, 2, rows[3][2]), (6, 3, rows[9][2]), (12, 0, rows[12][2][:4]), (18, 2, []), (24, 1, [0.0] * 8)]
    rows += [(30, None, rows[0][2]), (36, 1, None), (42, 1, [None] + rows[0][2][1:]), (48, 1, [float("nan")] * 8), (54, 1, [float("inf")] * 8), (60, 1, [1e30] * 8)]
    got = found(mine(frame(spark, rows).repartition(parts), F.col("id") % 6 == 0))
    want = brute(rows, lambda i: i % 6 == 0)
    assert got == want and len(want) > 300


def test_hot_vector_and_hot_label(spark):
    rng = np.random.default_rng(4)
    hot = [0.5, 0.25, -0.5, 0.75]
    rows = [(i, 0 if i % 3 else int(rng.integers(5)), hot if i % 2 else [float(c) for c in np.float32(rng.normal(size=4))]) for i in range(400)]
    assert found(mine(frame(spark, rows), F.col("id") % 20 == 0)) == brute(rows, lambda i: i % 20 == 0)


def test_empty(spark):
    none = frame(spark, [(1, 1, [1.0]), (2, 1, [2.0])])
    for df in (none.limit(0), none):
        got = mine(df, F.col("id") % 50 == 0)
        assert got.collect() == [] and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mine(none, F.col("id") == 1).collect() == []  # positives, but no other label
    with pytest.raises(ValueError):
        mine(frame(spark, [(0, 1, [0.0] * 5000)]), F.col("id") == 0)


def test_tree_spans_and_bounds_hold():
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(40, 6)) * 50)
    order, parents, edges = spanning_tree(x)
    assert sorted(order) == list(range(40)) and parents[0] == -1 and all(0 <= parents[k] < k for k in range(1, 40))
    off = np.linalg.norm(x[:, None] - x[None], axis=2)
    joined, total = {0}, 0.0
    while len(joined) < 40:  # the weight of a least tree
        d, k = min((off[a, b], b) for a in joined for b in range(40) if b not in joined)
        joined.add(k)
        total += d
    assert math.isclose(edges.sum(), total)


def test_bounds_spare_scores_and_lose_nothing():
    rng = np.random.default_rng(8)
    anchors = np.floor(1000 + rng.normal(size=(64, 16)) * 8)  # near each other, so bounds are tight
    order, parents, edges = spanning_tree(anchors)
    tree = Tree(0, 0, np.arange(64), anchors[order], parents, edges)
    x = np.floor(rng.normal(size=(500, 16)) * 300)
    own = Candidates(np.arange(500), np.zeros(500, bool), x, np.linalg.norm(x, axis=1))
    exact, got = anchors[order] @ x.T, {}
    scored = walk(tree, own, lambda nodes, lo, hi: hi >= 2_000_000, lambda node, scores, rows: got.update({(int(node), int(r)): int(s) for s, r in zip(scores, rows, strict=True)}))
    want = {(int(a), int(b)): int(exact[a, b]) for a, b in np.argwhere(exact >= 2_000_000)}
    assert want and want.items() <= got.items()
    assert scored < exact.size / 2
