"""Exact top-k search against all pairs."""

import numpy as np
import pytest

from factweave.llm import exact_search as es


def plain(rows, k=20, every=20):
    good = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good = sorted({(i, tuple(v)) for i, v in good})
    out = []
    for i, q in good:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in good if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def frame(spark, rows):
    """Further columns carry names that the search uses itself."""
    return spark.createDataFrame([(*r, r[0], 0.5, "q") for r in rows], "vec_id long, embedding array<float>, label int, id long, score double, query string")


@pytest.mark.parametrize("chunk", [4096, 16])
def test_clusters_ties_and_copies(spark, monkeypatch, chunk):
    monkeypatch.setattr(es, "CHUNK", chunk)
    monkeypatch.setattr(es, "QUERY_CHUNK", chunk)
    monkeypatch.setattr(es, "SLICE", 24)
    monkeypatch.setattr(es, "SAMPLE", 64)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + rng.normal(scale=0.1, size=8)).astype(np.float32).tolist(), 0) for k in range(400)]
    rows += [(1000 + k, rows[7][1], 0) for k in range(120)] + [(2000 + k, [0.5] * 8, 0) for k in range(30)] + [rows[3], rows[40]]
    rows += [(-20, [1.0] * 8, 0), (5000, None, 0), (5020, [float("nan")] * 8, 0), (5040, [1.0, None, *[0.0] * 6], 0), (5060, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (5080, [3.0] * 5, 0), (5100, [], 0)]
    got = sorted(map(tuple, es.top_k(frame(spark, rows)).collect()))
    assert got == plain([r[:2] for r in rows])


def test_few_and_none(spark):
    assert es.top_k(frame(spark, [])).count() == 0
    assert es.top_k(frame(spark, [(20, None, 1)])).count() == 0
    rows = [(0, [1.0], 0), (1, [2.0], 0), (20, [-1.0], 0)]
    assert sorted(map(tuple, es.top_k(frame(spark, rows)).collect())) == plain([r[:2] for r in rows])


def test_large_components(spark):
    rows = [(k, [float(2.0 ** (k % 30)), 3.0 * k, -1.5], 0) for k in range(60)]
    assert sorted(map(tuple, es.top_k(frame(spark, rows)).collect())) == plain([r[:2] for r in rows])
    assert es.products(np.array([[1e30]]), np.array([[1e30], [-1e30]])).tolist() == [[2**63 - 1, -(2**63)]]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(800, 16)) * 64)
    pivots = es.Pivots(x[:200], np.arange(200))
    cell, gap = pivots.place(x)
    q = np.floor(rng.normal(size=(50, 16)) * 64)
    scores = es.products(q, x)
    for c in np.unique(cell):
        own = cell == c
        bound = pivots.bounds(q, np.array([c // pivots.shells]), gap[own].min(keepdims=True), gap[own].max(keepdims=True), (x[own] ** 2).sum(1).max(keepdims=True))
        assert (scores[:, own] <= bound).all()


def test_rows_move_only_to_blocks_that_ask(spark, monkeypatch):
    monkeypatch.setattr(es, "CHUNK", 50)
    monkeypatch.setattr(es, "QUERY_CHUNK", 4)
    moved = []
    original = es.asked_chunks

    def counted(index, asked):
        out = original(index, asked)
        moved.append((out.count(), asked.select("cell", "block").distinct().count()))
        return out

    monkeypatch.setattr(es, "asked_chunks", counted)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 12)) * 20
    rows = [(k, (centres[k % 40] + rng.normal(scale=0.05, size=12)).astype(np.float32).tolist(), 0) for k in range(4000)]
    got = sorted(map(tuple, es.top_k(frame(spark, rows)).collect()))
    assert got == plain([r[:2] for r in rows])
    queries, blocks = 200, 50
    assert sum(n for n, _ in moved) < 0.35 * len(rows) * blocks  # not every row to every block
    assert sum(n for n, _ in moved) <= sum(pairs for _, pairs in moved) * len(rows) / 4
