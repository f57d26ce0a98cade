"""Hard negatives against all products, bounds and ranges, odd rows."""

import math

import numpy as np
import pytest

from latticework.llm import hard_negatives as H

SF = "/root/testdata/sf0.001"


def plain(rows, every=50, relabel=False, k=5, m=3):
    """All anchors against all rows; rows are (vec_id, label, embedding)."""
    good = {}
    for vec_id, label, v in rows:
        if vec_id is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        label = (label + 1) % 10 if relabel and vec_id % 7 == 0 else label
        good[vec_id, label, tuple(math.floor(256 * c) for c in v)] = True
    out = []
    for a, label, x in good:
        if a % every:
            continue
        others = [(b, lb, sum(p * q for p, q in zip(x, y, strict=True))) for b, lb, y in good if b != a and len(y) == len(x)]
        for b, _, p in sorted([o for o in others if o[1] == label], key=lambda o: (-o[2], o[0]))[:k]:
            fits = [o for o in others if o[1] != label and 50 * p <= 100 * o[2] <= 95 * p]
            out += [(a, b, r + 1, o[0], p, o[2]) for r, o in enumerate(sorted(fits, key=lambda o: (-o[2], o[0]))[:m])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in "anchor_id positive_id rank negative_id positive_score negative_score".split()) for r in df.collect())


def test_whole_query(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(H.op12_hard_negatives(spark, SF)) == plain(rows, relabel=True)


@pytest.mark.parametrize("chunk, block, sample", [(64, 7, 0), (10_000, 10_000, 500), (40, 1000, 30)])
def test_lengths_copies_and_near_copies(spark, chunk, block, sample):
    """Clustered vectors of very different lengths, a vector that a third of the rows share: many blocks and parts, with and without first bounds."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(k, int(rng.integers(4)), (rng.choice([0.1, 1.0, 30.0]) * (centres[k % 6] + 0.05 * rng.normal(size=8))).tolist()) for k in range(300)]
    rows += [(k, int(rng.integers(4)), centres[0].tolist()) for k in range(300, 450)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert rows_of(H.mine(df, every=10, chunk=chunk, block=block, sample=sample)) == plain(rows, every=10)


def test_odd_rows(spark):
    """Nulls, components that aren't finite, zero vectors, other dimensions, repeated rows and ids, negative ids, clashing columns, small labels."""
    v = lambda *x: list(map(float, x))
    rows = [(0, 1, v(1, 2)), (0, 1, v(1, 2)), (0, 2, v(2, 1)), (50, 1, v(0, 0)), (1, 1, v(1, 1)), (2, 2, v(1, 0.9)), (3, 2, v(0.5, 0.5)), (4, 1, None), (None, 1, v(1, 1)), (5, None, v(1, 1)), (6, 2, [1.0, None]), (7, 2, v(math.nan, 1)), (8, 2, v(math.inf, 1)), (9, 1, v(1, 2, 3)), (100, 2, v(1, 2, 3)), (10, 2, v(3, 2, 1)), (11, 1, v(1, 1, 1)), (-50, 2, v(-1, 1)), (12, 2, v(0.9, 0.8)), (12, 2, v(0.9, 0.8)), (13, 3, []), (150, 9, v(1, 1))]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, h long, part int")
    got = rows_of(H.mine(df))
    assert got == plain(rows) and got


def test_empty_table(spark):
    assert H.mine(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_ranges_hold_all_that_reach_a_score_and_prune():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(3000, 6)) / 3).astype(np.int64)
    part = H.Bucket(np.arange(3000), np.zeros(3000, np.int64), x)
    q = x[:40]
    every = q @ x.T
    for share in (0.99, 0.9, 0.5, 0.0, -1.0):
        least = share * np.sqrt((q**2).sum(axis=1)) * part.longest
        sizes = []
        for i, rows in enumerate(part.candidates(q, least)):
            reach = set(np.flatnonzero(every[i] >= least[i]).tolist())
            assert rows is None or reach <= set(rows.tolist())
            sizes.append(3000 if rows is None else len(rows))
        if share >= 0.9:
            assert np.mean(sizes) < 300  # near copies are found among a tenth of the rows


def test_products_are_exact_beyond_doubles():
    q = np.full((1, 64), (1 << 24) - 1, np.int64)
    assert H.products(q, q)[0, 0] == 64 * ((1 << 24) - 1) ** 2
