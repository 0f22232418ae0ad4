"""Neighbours against all pairs; small tables exactly, larger ones by recall."""

import math
import random

import numpy as np
import pytest

from tests.conftest import SF
from tidemark.llm import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, c string, cell long, v int"


def brute(rows, k=5, every=50):
    seen = {(r.vec_id, tuple(r.embedding)) for r in rows if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)}
    vecs = [(i, np.array(v, np.float64)) for i, v in sorted(seen)]
    out = []
    for i, q in vecs:
        if i % every == 0:
            near = sorted((-float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))), j) for j, v in vecs if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near[:k])]
    return sorted(out)


def rounded(rows):
    return sorted((r[0], r[1], r[2], round(r[3], 12)) for r in rows)


def table(spark, n, dims=12, copies=0, near=0, seed=2):
    g = random.Random(seed)
    vec = lambda: [g.gauss(0, 1) for _ in range(dims)]
    rows = [(k, vec(), 1) for k in range(n)]
    one = vec()
    rows += [(n + k, one, 1) for k in range(copies)] + [(n + copies + k, [x + g.gauss(0, 0.01) for x in one], 1) for k in range(near)]
    rows += [(-50, None, 1), (-100, [None] * dims, 1), (-150, [0.0] * dims, 1), (-200, [float("inf")] * dims, 1), (-250, [], 1), (None, vec(), 1)]
    if n > 60:
        rows += [rows[0], rows[7], (-300, rows[0][1], 1), (-350, vec()[:5], 1), (-351, vec()[:5], 1)]
    return spark.createDataFrame([(*r, "x", 0, 0) for r in rows], SCHEMA)


@pytest.mark.parametrize("n,copies,near,block", [(0, 0, 0, 512), (1, 0, 0, 512), (4, 0, 0, 512), (300, 120, 60, 512), (300, 0, 90, 16)])
def test_one_cell_is_exact(spark, monkeypatch, n, copies, near, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    df = table(spark, n, copies=copies, near=near)
    assert rounded(nearest.op12_query(df).collect()) == rounded(brute(df.collect()))


@pytest.mark.parametrize("few,cell", [(200_000, 16), (-1, 4)])
def test_many_cells_reach_the_recall(spark, monkeypatch, few, cell):
    monkeypatch.setattr(nearest, "FEW", few)
    monkeypatch.setattr(nearest, "BLOCK", 8)
    df = table(spark, 900, copies=150, near=150)
    got = nearest.nearest(df, df.vec_id % 50 == 0, cell=cell).collect()
    want = brute(df.collect())
    assert len(got) == len(want)
    both = {r[:1] + r[2:3] for r in want} & {(r.query_id, r.vec_id) for r in got}
    assert len(both) >= 0.9 * len(want)
    score = {(r[0], r[2]): r[3] for r in brute(df.collect(), k=10_000)}
    assert all(abs(score[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got)


def test_a_query_in_an_empty_corner_is_compared_with_everything(spark, monkeypatch):
    monkeypatch.setattr(nearest, "RECALL", 0.0)
    df = table(spark, 400)
    got = nearest.nearest(df, df.vec_id % 50 == 0, cell=2, tables=1).collect()
    assert len(got) == len(brute(df.collect()))


def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert rounded(nearest.op12_query(df).collect()) == rounded(brute(df.collect()))


def test_probes_come_in_the_order_of_their_scores():
    x = nearest._unit(np.random.default_rng(1).normal(size=(5, 10)))
    for turns in ([16], [16, 3], [4, 4, 2]):
        score = np.zeros((5, 1))
        for s in nearest._scores(x, 0, turns):
            score = (score[:, :, None] + s[:, None, :]).reshape(5, -1)
        for m in (1, 3, 17, score.shape[1]):
            got = nearest.probes_of(x, 0, turns, m)
            assert np.allclose(np.take_along_axis(score, got, axis=1), -np.sort(-score, axis=1)[:, :m])
        assert (nearest.cells_of(x, 0, turns) == nearest.probes_of(x, 0, turns, 1)[:, 0]).all()
