from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from automill.llm import hard_negatives, queries_mining
from conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, id long, row string, query string, leaf int"


def brute(rows, shift=True):
    """All anchors against all rows, in plain integers."""
    kept = []
    for vec_id, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if shift and vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (anchor, label, q) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        found = sorted(((-sum(x * y for x, y in zip(q, v)), i is None, i or 0, k) for k, (i, _, v) in enumerate(kept) if k != a))
        same = [(kept[k][0], -s) for s, _, _, k in found if kept[k][1] == label][:5]
        other = [(kept[k][0], -s) for s, _, _, k in found if kept[k][1] != label]
        for i, p in same:
            hard = [(j, s) for j, s in other if 30 * p <= 100 * s <= 90 * p][:10]
            out += [(anchor, i, r, j, p, s) for r, (j, s) in enumerate(hard, 1)]
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x", "y", 0) for r in rows], SCHEMA)
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return ordered(hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label=shifted, **how).collect())


def vectors(seed, n, width, spread):
    """Clusters, with copies and ties."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width))
    data = centres[r.integers(0, 6, n)] + spread * r.normal(size=(n, width))
    data[r.random(n) < 0.2] = centres[0]
    return [(i, [float(x) for x in v], int(r.integers(0, 4))) for i, v in enumerate(np.round(data, 1).astype(np.float32).tolist())]


@pytest.mark.parametrize("how", [dict(leaves=1), dict(leaves=16, chunk_rows=40), dict(leaves=64, chunk_rows=7, waves=(1,)), dict(leaves=9, chunk_rows=30, waves=())])
def test_mine(spark, how):
    """Whatever the tree, chunks and waves; with copies, ties, repeated rows, nulls in every column, and columns of clashing names."""
    rows = vectors(5, 620, 6, 0.4)
    rows += [rows[100], rows[200], rows[11], (None, rows[5][1], 1), (None, rows[100][1], 2), (901, None, 1), (700, [1.0] * 6, None), (800, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1)]
    rows += [(900, [float("nan")] * 6, 1), (902, [float("inf")] * 6, 1), (1000, [0.0] * 6, 1), (1100, [2.0, 1.0], 1), (1200, [], 2), (-100, rows[3][1], -3)]
    want = ordered(brute(rows))
    assert mined(spark, rows, **how) == want
    assert len(want) > 100


def test_one_vector(spark):
    """All rows the same: nothing splits the tree, ties go by id. And scores below zero."""
    rows = [(i, [0.5, -0.25], i % 3) for i in range(250)]
    assert mined(spark, rows, chunk_rows=20) == ordered(brute(rows)) == []
    rows = [(i, [(-1.0) ** i * 0.9, i / 300], i % 2) for i in range(250)] + [(i, [(-1.0) ** i * 0.6, i / 300], 5) for i in range(250, 500)]
    assert mined(spark, rows, chunk_rows=20) == ordered(brute(rows)) != []


def test_empty_and_large(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, None, 1)]) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    with pytest.raises(ValueError, match="too large"):
        mined(spark, [(100, [1e30], 1), (1, [2.0], 1)])


def test_bounds_hold():
    """No row's score lies outside its leaf's bounds, and they rule out leaves of clustered rows."""
    data = np.array([v for _, v, _ in vectors(3, 900, 3, 0.05)]) * 100
    data = np.floor(data)
    most = float((data * data).sum(1).max())
    tree = hard_negatives.Tree.fit(data[:300], most, 16)
    far = hard_negatives.distances(hard_negatives.augmented(data, most), tree.points)
    leaf = tree.leaf(far)
    assert tree.leaves > 4 and set(leaf) <= set(range(tree.leaves))
    near, wide = (np.array([f(far[leaf == k], axis=0, initial=i) for k in range(tree.leaves)]) for f, i in ((np.min, np.inf), (np.max, -np.inf)))
    low, high = hard_negatives.bounds(data[:50], tree, near, wide)
    scores = data[:50] @ data.T
    assert (scores >= low[:, leaf]).all() and (scores <= high[:, leaf]).all()
    assert (high < scores.max(1)[:, None]).mean() > 0.3


def test_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = ordered(queries_mining.op13_hard_negatives(spark, SF).collect())
    assert got == ordered(brute(rows)) != []
