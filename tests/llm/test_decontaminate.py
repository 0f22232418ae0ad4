"""Benchmark decontamination against a comparison of every alignment of every document and item."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.cases import documents
from tidemark.llm import decontaminate as d


def test_masks_meet_their_guarantee():
    for bad in itertools.combinations(range(d.WINDOW), d.DIFFER):
        assert any(all(p + o not in bad for o in m) for m in d.MASKS for p in range(d.WINDOW - m[-1]))


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_leaks_match_all_alignments(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.item_id: words(r.text) for r in bench.collect()}
    g, more = random.Random(3), []
    for k, (i, ws) in enumerate(sorted(texts.items())):  # whole, changed, cut and too much changed passages
        ws = list(ws)
        for p in g.sample(range(len(ws)), k % 8):
            ws[p] = "changed"
        a = g.randrange(0, max(1, len(ws) - 16)) if k % 3 == 0 else 0
        more.append((2000 + k, "Before it, " + (" " if k % 2 else " ### ").join(ws[a:a + 15 + k]).upper() + " after it.", "en", "a"))
    bench = bench.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "too short an item"), (903, "one two three four five six seven eight"),
                                                      (904, "Quixotic"), (905, "five fine words in order"), (906, " ".join(f"q{i}" for i in range(11)))], "item_id long, text string"))
    texts = {r.item_id: words(r.text) for r in bench.collect()}
    more += [(3000, "x one two three four five six seven eight y", "en", "a"), (3001, "x one two three four five six SEVEN nine y", "en", "a"),
             (3002, "x one two three four six six SEVEN nine y", "en", "a"), (3003, "QUIXOTIC, too short an item", "en", "a"), (3004, "five fine words of order", "en", "a"),
             (3005, "five good words of order", "en", "a"), *((3010 + n, " ".join(f"q{i}" if i % 4 or i >= 4 * n else "no" for i in range(11)), "en", "a") for n in range(4))]
    docs = documents(spark, SF, more)
    ids, want = {}, {}
    num = lambda ws: np.array([ids.setdefault(w, len(ids)) for w in ws])
    for r in docs.collect():
        ws = num(words(r.text))
        for i, item in texts.items():
            item = num(item)
            if not len(item) or not len(np.intersect1d(ws, item)) or len(ws) < min(len(item), 15):
                continue
            at, to = np.nonzero(ws[:, None] == item[None])
            shifts, same = np.unique(at - to, return_counts=True)
            for s in shifts[same >= min(len(item), 15) - min(len(item), 15) // 5].tolist():
                for a, z, n in d.overlaps(ws, item, s):
                    o = want.setdefault((r.doc_id, i), [a, z - 1, set(), 0])
                    o[0], o[1], o[3] = min(o[0], a), max(o[1], z - 1), max(o[3], n)
    got = {(r.doc_id, r.item_id): (r.first_word, r.last_word, r.n_same) for r in d.op6_query(docs, bench).collect()}
    assert got == {k: (v[0], v[1], v[3]) for k, v in want.items()}
    assert (3000, 903) in got and (3001, 903) in got and (3002, 903) not in got and {(3003, 904), (3003, 902), (3004, 905)} < set(got) and (3005, 905) not in got
    assert [(3010 + n, 906) in got for n in range(4)] == [True, True, True, False] and len(got) > 30
    assert d.op6_query(docs.limit(0), bench).count() == 0 and d.op6_query(docs, bench.limit(0)).count() == 0


def test_repeated_rows_and_other_id_types(spark):
    item = "this passage of the benchmark has more than fifteen words so that it can be found in a text"
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    docs = spark.createDataFrame([("x", "see " + item)] * 2, "doc_id string, text string")
    assert [(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()] == [("x", "a")]
    odd = docs.select(F.expr("DATE'2020-01-02'").alias("doc_id"), "text")
    assert [(str(r.doc_id), r.item_id) for r in d.find_leaks(odd, bench).collect()] == [("2020-01-02", "a")]
    assert d.find_leaks(docs, bench, least=20).count() == 0
    assert d.find_leaks(docs.select(F.lit(None).cast("int").alias("doc_id"), "text"), bench).count() == 1


def test_pieces_meet_their_guarantee():
    for n in range(1, d.WINDOW):
        words = np.arange(n) + 100
        (k, at, _), = d.item_seeds(words)
        piece = len(d.PIECES[k - len(d.MASKS)])
        assert at[-1] + piece <= n
        for bad in itertools.combinations(range(n), n * d.DIFFER // d.WINDOW):
            assert any(not set(range(a, a + piece)) & set(bad) for a in at.tolist())
