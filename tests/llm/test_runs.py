"""Runs against every period at every place, Lyndon arrays against their definition."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.cases import documents
from tidemark.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=12):
    """Per period the maximal stretches of equal words that far apart; a period counts if no smaller one holds there."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q) and not any(q % p == 0 and all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out[i, length] = q
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_lyndon(w, inverse):
    out = []
    key = [(-x if inverse else x) for x in w]
    for i in range(len(w)):
        out.append(max(k for k in range(1, len(w) - i + 1) if all(key[i:i + k] < key[i + s:i + k] for s in range(1, k))))
    return out


def brute(r):
    w = WORD.findall(r.text or "")
    n = len(w)
    if r.doc_id is not None and n:
        h = zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(w)
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    return (r.doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


@pytest.mark.parametrize("inverse", [False, True])
def test_lyndon_arrays(inverse):
    g = random.Random(3)
    for _ in range(400):
        w = [g.randrange(g.choice([1, 2, 3, 9])) for _ in range(g.randrange(1, 24))]
        assert runs.lyndon_array(w, inverse) == brute_lyndon(w, inverse), w


@pytest.mark.parametrize("least", [2, 3, 12])
def test_runs_of_random_words(least):
    g = random.Random(least)
    texts = []
    for _ in range(300):
        w = []
        while len(w) < g.randrange(70):
            part = [g.randrange(g.choice([2, 3, 40])) for _ in range(g.randrange(1, 9))]
            w += (part * g.randrange(1, 5))[:g.randrange(1, 30)]
        texts.append(w)
    got = runs.runs_of(np.array([x for w in texts for x in w], np.int64), np.array([len(w) for w in texts], np.int64), least)
    assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, w in enumerate(texts) for r in brute_runs(w, least)]


def test_query_against_every_period(spark, monkeypatch):
    monkeypatch.setattr(runs, "SLICE", 5_000)
    more = [(5000 + k, ("a b c d e f g " * (k % 5) + "x y " * k + "z " * (k % 17)), "en", "a") for k in range(120)]
    docs = documents(spark, SF, more).filter("length(text) < 20000 or text is null")
    got = sorted((tuple(r) for r in runs.op13_query(docs).collect()), key=repr)
    assert got == sorted((brute(r) for r in docs.collect()), key=repr)


def test_long_texts_empty_tables_and_clashing_columns(spark):
    docs = documents(spark)
    out = runs.find_runs(docs, keep=("doc_id", "n_words", "h"))
    assert out.columns == ["doc_id", "in_n_words", "h", "n_words", "runs", "collapsed"]
    long = out.filter("doc_id = 6").first()
    # the counter comes back every 977 triples, so the whole text is one run
    assert long.n_words == 90_000 and [tuple(r) for r in long.runs] == [(0, 90_000, 2931)] and len(long.collapsed.split()) == 2931
    one = runs.find_runs(spark.createDataFrame([(1, "word " * 200_000)], "doc_id int, text string")).first()
    assert [tuple(r) for r in one.runs] == [(0, 200_000, 1)] and one.collapsed == "word"
    assert runs.op13_query(docs.limit(0)).count() == 0
    assert [tuple(r)[:6] for r in runs.op13_query(docs.filter("doc_id = 1")).collect()] == [(1, 0, None, None, None, None)]
