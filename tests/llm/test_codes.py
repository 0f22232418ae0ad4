"""Codes against a search of all entries in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tests.conftest import SF
from tidemark.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, _v int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    cut = {id(r): [tuple(math.floor(256 * x) for x in r.embedding[p * len(r.embedding) // parts:(p + 1) * len(r.embedding) // parts]) for p in range(parts)] for r in kept}
    seeds = sorted(kept, key=lambda r: (r.vec_id is None, r.vec_id or 0, cut[id(r)]))[:entries]
    books = [[cut[id(r)][p] for r in seeds] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            hit = {}
            for r in kept:
                hit.setdefault(near(cut[id(r)][p], books[p])[1], []).append(cut[id(r)][p])
            books[p] = [tuple(sum(c) // len(hit[k]) for c in zip(*hit[k])) if k in hit else e for k, e in enumerate(books[p])]
    found = [(r, [near(x, b) for x, b in zip(cut[id(r)], books)]) for r in kept]
    total = {}
    for r, f in found:
        total[r.label] = total.get(r.label, 0) + sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r.vec_id, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[r.label], sha) for r, f in found), key=repr)


def table(spark, n, dims=32, seed=1):
    g = random.Random(seed)
    rows = [(k, [g.choice([g.gauss(0, 1), 0.0, 0.25]) for _ in range(dims)], g.choice([0, 1, None]), "x", 1, 2) for k in range(n)]
    rows += [(n, None, 1, "x", 1, 2), (n + 1, [None] * dims, 1, "x", 1, 2), (n + 2, [float("nan")] * dims, 1, "x", 1, 2), (n + 3, [float("-inf")] + [0.0] * (dims - 1), 1, "x", 1, 2)]
    if n:
        rows += [rows[0], (None, rows[1][1], None, "x", 1, 2), (n + 4, rows[2][1], 1, "x", 1, 2)]  # a repeated row, a null id, a tie
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n", [0, 1, 40, 300])
def test_codes_match_a_full_search(spark, n):
    df = table(spark, n)
    assert sorted((tuple(r) for r in codes.op11_query(df).collect()), key=repr) == brute(df.collect())


def test_given_table(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute(df.collect())
    assert sorted((tuple(r) for r in codes.op11_query(df).collect()), key=repr) == want
    monkeypatch.setattr(codes, "FEW", 0)  # the totals by a shuffle
    assert sorted((tuple(r) for r in codes.op11_query(df).collect()), key=repr) == want


def test_the_box_of_a_far_vector_holds_the_nearest_entry():
    g = np.random.default_rng(4)
    for scale in (3, 500, codes.LIMIT):
        e, x = g.integers(-scale, scale, (64, 4)), g.integers(-codes.LIMIT, codes.LIMIT, (200, 4))
        x[:50] = e[g.integers(0, 64, 50)]
        entry, dist = codes.Codebook(e).nearest(x)
        full = ((x[:, None].astype(object) - e[None]) ** 2).sum(axis=2)
        assert entry.tolist() == [r.tolist().index(min(r)) for r in full] and dist.tolist() == full.min(axis=1).tolist()


def test_odd_lengths_and_huge_components(spark):
    rows = [(k, [float(k)] * 16, 0) for k in range(3)] + [(3, [1.0] * 17, 0), (4, [], 0), (5, [3e38] * 16, 0)]
    got = {r.vec_id: r.error for r in codes.op11_query(spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")).collect()}
    assert set(got) == {0, 1, 2, 5} and not any(got.values())
