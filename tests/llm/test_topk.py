"""Exact top-k search against brute force: ties, repeats, nulls, odd numbers, several lengths."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import topk

SCHEMA = "vec_id long, embedding array<float>, cell string, rid string, near int"  # cell, rid and near clash with names used inside


def brute(rows, k, every):
    usable = []
    for at, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) and abs(np.float32(x)) < 1 << 20 for x in v):
            usable.append((at, i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = []
    for at, i, v in usable:
        if i is not None and i % every == 0:
            scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, j) for bt, j, w in usable if bt != at and len(v) == len(w)]
            out += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(150)]
    out += [(200 + i, out[5][1]) for i in range(60)]  # one vector that many rows hold
    out += [(300 + i, [x + rng.gauss(0, 0.01) for x in out[10][1]]) for i in range(20)]
    out += [(5, out[7][1]), (5, out[7][1]), (None, out[10][1]), (None, out[5][1]), (-10, out[3][1])]
    out += [(400, None), (405, [1.0, None, 0, 0, 0, 0]), (410, [float("nan")] * 6), (415, [float("inf")] * 6), (420, [3e6] * 6)]
    out += [(500 + i, [rng.random(), rng.random()]) for i in range(4)] + [(505, []), (510, []), (515, [0.0] * 6), (520, [1e4] * 6), (525, [-1e4, 1e4, 0, 0, 0, 0])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v], "c", "r", 1) for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("pivots", "block", "asked", "k"), [(48, 16_384, 4_096, 4), (5, 20, 6, 7), (1, 9, 3, 1)])
def test_equals_brute_force(spark, rows, monkeypatch, pivots, block, asked, k):
    for name, value in (("PIVOTS", pivots), ("BLOCK_ROWS", block), ("QUERY_ROWS", asked)):
        monkeypatch.setattr(topk, name, value)
    found = topk.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0, k)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, k, 5)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.5, -0.25]), (2, [0.1, 0.1])]
    found = topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, 20)
    assert sorted(map(tuple, found.collect())) == brute(rows, 20, 20)
    assert topk.top_k(frame(spark, []), F.col("vec_id") % 20 == 0, 20).collect() == []
    assert topk.top_k(frame(spark, [(1, [1.0])]), F.col("vec_id") % 20 == 0, 20).collect() == []


def test_bounds_hold_and_stop_early():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 0.05, (2000, 16)) + rng.normal(0, 0.5, (20, 1, 16)).repeat(100, 1).reshape(2000, 16), rng.normal(0, 0.2, (500, 16))]
    x = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True))
    p = topk.Pivots(x[::80], (x**2).sum(axis=1).max())
    q = x[::50]
    near, asked = p.of_rows(x), p.of_queries(q)
    lower = np.abs(asked[:, None, :] - near[None]).max(axis=2)
    bounds = p.most((q**2).sum(axis=1), lower)
    scores = q @ x.T
    assert (bounds >= scores).all()
    seen = 0
    for i in range(len(q)):
        at, found = topk.best_of(x, q[i], bounds[i], float("-inf"), 10)
        assert sorted(found, reverse=True)[:10] == sorted(scores[i], reverse=True)[:10]
        seen += (bounds[i] >= np.sort(scores[i])[-10]).sum()
    assert seen < 0.5 * len(q) * len(x)  # many candidates are never evaluated
