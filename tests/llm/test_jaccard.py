"""Jaccard components against all pairs on small tables, with shingles hot enough to be split."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.cases import documents
from tidemark.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width=4):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width=4, percent=85):
    sets = [shingle_set(r.text, width) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        least.setdefault(find(k), []).append(r.doc_id)
    pick = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return sorted(((r.doc_id, len(sets[k]), pick[find(k)] if sets[k] else r.doc_id) for k, r in enumerate(rows)), key=repr)


def near_copies(n, edits, seed, start):
    g = random.Random(seed)
    base = [f"word{g.randrange(400)}" for _ in range(150)]
    out = []
    for k in range(n):
        ws = list(base)
        for _ in range(g.randrange(edits)):
            p = g.randrange(len(ws))
            ws[p:p + 1] = g.choice([[], ["other"], [ws[p].upper(), f"new{g.randrange(999)}"], [ws[p].upper()]])
        out.append((start + k, " ".join(ws), "en", "a"))
    return out


@pytest.mark.parametrize("hot,block", [(64, 1024), (4, 8)])
def test_components_match_all_pairs(spark, monkeypatch, hot, block):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    more = near_copies(90, 9, 1, 5000) + near_copies(40, 14, 2, 6000) + [(7000 + k, "a b c" if k % 2 else "A b  c", "en", None) for k in range(6)]
    docs = documents(spark, SF, more)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.op4_query(docs).collect()), key=repr)
    assert got == brute(docs.collect())


@pytest.mark.parametrize("width", [4, 5])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 6])
def test_shingles_of_a_slice_of_few_words(n, width):
    h, doc = jaccard.shingles(np.arange(n, dtype=np.int64), np.array([n]), width)
    assert len(h) == len(doc) == min(n, max(n - width + 1, 1))


def test_empty_tables_and_texts(spark):
    assert jaccard.op4_query(documents(spark).limit(0)).count() == 0
    got = jaccard.op4_query(documents(spark).filter("doc_id in (1, 2, 3)")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 50)] + [(5, 5)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{k: 5 for k in range(6, 50)}}


def test_components_take_few_rounds_and_earlier_components(spark, monkeypatch):
    g = np.random.default_rng(3)
    node = g.permutation(4000).tolist()
    chain, other = list(zip(node[:1999], node[1:2000], strict=True)), list(zip(node[2000:3999], node[2001:], strict=True))
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    real, written = jaccard.saved, []
    monkeypatch.setattr(jaccard, "saved", lambda df, kind="table": (written.append(kind), real(df, kind))[1])
    first = jaccard.components(frame(chain + other))
    assert {r.node: r.root for r in first.collect()} == {x: min(part) for part in (node[:2000], node[2000:]) for x in part if x != min(part)}
    assert len(written) <= 4  # a chain of n nodes took about log2(n) rounds
    joined = jaccard.components(frame([(node[5], node[2005])]), first)
    assert {r.node: r.root for r in joined.collect()} == {x: 0 for x in node if x}
    assert jaccard.components(frame([]), first).count() == 3998 and jaccard.components(frame([])).count() == 0


def test_prefixes_are_deleted_once_read(spark, monkeypatch):
    real, written = jaccard.saved, []
    monkeypatch.setattr(jaccard, "saved", lambda df, kind="table": (written.append((kind, real(df, kind))), written[-1][1])[1])
    out = jaccard.op4_query(documents(spark))
    left = {k: sum(spark._jvm.java.io.File(f.removeprefix("file:")).exists() for k2, t in written if k2 == k for f in t.inputFiles()) for k in {k for k, _ in written}}
    assert not any(left[k] for k in ("prefixes", "tokens", "live", "hubs", "rooted", "star", "more", "pairs", "sets", "classes"))
    assert out.count() == documents(spark).count()


def test_only_texts_of_candidate_pairs_are_cut_into_words(spark, monkeypatch):
    texts = spark.createDataFrame([(k, f"text {k} of five words" if k else None) for k in range(200)], "t long, text string")
    cut = []
    real = jaccard._hashed
    monkeypatch.setattr(jaccard, "_hashed", lambda c: (cut.append(c), real(c))[1])
    sets, bits = jaccard._whole_sets(texts, jaccard._bitmap(texts.filter("t in (0, 7, 9)").select("t")), 4)
    assert cut == ["text"] and {len(r.s) for r in sets.collect()} == {16} and sets.count() == 2
    bits.destroy()
