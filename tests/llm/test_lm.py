"""LM scoring: base scores by plain counts, a proper and causal model, each token scored once, better than unigrams."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.cases import documents
from tidemark.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 50])
def test_base_scores_match_plain_counts(spark, frequent):
    docs = documents(spark, SF)
    rows = docs.collect()
    toks = [[*WORD.findall((r.text or "").translate(LOW)), "<end>"] for r in rows]
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(r.doc_id), h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4))
                  for r, t, h in zip(rows, toks, held, strict=True))
    got = lm.score_texts(docs, frequent=frequent, max_windows=100, sample=50).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(round(r.score, 6))
    assert by[1] == by[2] and len(by[4]) == 1  # null and empty; a repeated row


@pytest.fixture(scope="module")
def model(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    ids, lengths = lm.encode(texts[:700], lm.VOCABULARY)
    counts = np.bincount(ids, minlength=lm.tokenizer(lm.VOCABULARY).n_vocab + 1).astype(float)
    return lm.train(ids, lengths, counts, max_windows=6000), counts, texts[700:]


def test_probabilities_sum_to_one_and_see_only_the_past(model):
    m, _, _ = model
    ids = np.arange(40, dtype=np.int64) * 7
    every = np.repeat(ids[None, :3], len(m.of) - 1, 0)
    every[:, 2] = np.arange(len(m.of) - 1)
    last = lm.log_probs(m, every.reshape(-1), np.full(len(every), 3)) - lm.log_probs(m, ids[:2], np.array([2]))
    assert abs(np.exp(last).sum() - 1) < 1e-3
    a, b = lm.log_probs(m, ids[:20], np.array([20])), lm.log_probs(m, np.concatenate([ids[:20], ids[:1]]), np.array([21]))
    assert b[0] < a[0]


def test_every_token_is_scored_once():
    for n in (1, 31, 32, 33, 56, 57, 500):
        doc, start, skip = lm.windows(np.array([n, 3]))
        own = doc == 0
        seen = Counter(int(s + p) for s, k in zip(start[own], skip[own], strict=True) for p in range(k, lm.WINDOW) if s + p < n)
        assert seen == Counter(range(n)) and all(s + k >= min(lm.CONTEXT, s + k) for s, k in zip(start, skip, strict=True))


def test_batches_do_not_change_scores_and_held_out_texts_beat_unigrams(model):
    m, counts, texts = model
    ids, lengths = lm.encode(texts, lm.VOCABULARY)
    all_at_once = lm.log_probs(m, ids, lengths)
    assert np.allclose(all_at_once[:20], [lm.log_probs(m, *lm.encode([t], lm.VOCABULARY), chunk=3)[0] for t in texts[:20]], rtol=1e-3)
    unigram = np.log((counts + 1) / (counts + 1).sum())[ids].sum()
    assert all_at_once.sum() > 0.95 * unigram


def test_all_training_texts_are_learned_from(spark):
    g = np.random.default_rng(1)
    docs = spark.createDataFrame([(k, " ".join(f"{'abcdefgh'[i]}{k % 2}" for i in g.integers(0, 8, 30)) + (" zebra quilt" if k == 1900 else "")) for k in range(2000)], "doc_id long, text string")
    rows = lm._encoded(docs.select(F.col("doc_id").alias("row"), "doc_id", F.lit(False).alias("held_out"), "text", F.array(F.lit(0).cast("long")).alias("w")), lm.VOCABULARY, "bigint").repartition(3)
    got = rows.filter("kind is not null").groupBy("kind", "key").agg(F.sum("n").alias("n")).filter("kind = 'sub'").collect()
    counts = np.zeros(lm.tokenizer(lm.VOCABULARY).n_vocab + 1)
    counts[[r["key"] for r in got]] = [r["n"] for r in got]
    tree = lm.grown(counts)
    p = lm.start(counts, tree)
    out = lm.learned(rows.filter("kind is null"), p, tree)
    moved = (out["E"][:-1] != p["E"][:-1]).any(1)
    assert (moved == ((counts > 0) & (np.arange(len(counts)) < len(counts) - 1))).all()  # the end is predicted, never read


def test_context_tells_two_subwords_of_a_class_apart():
    counts = np.zeros(lm.tokenizer(lm.VOCABULARY).n_vocab + 1)
    a, b, x, y = 1000, 1001, 1002, 1003
    ids = np.array([(a, x) if k % 2 else (b, y) for k in np.random.default_rng(1).integers(0, 2, 8000)]).reshape(-1)
    counts[[a, b, x, y]] = 400
    counts[5000:5400] = 500  # so that x and y share a class
    m = lm.train(ids, np.full(500, 32), counts, max_windows=None, epochs=20, batch=16)
    assert lm.CLASSES >= 64 and m.of[x] == m.of[y]
    given = lambda *t: float(lm.log_probs(m, np.array(t), np.array([len(t)]))[0])
    assert given(a, x) - given(a, y) > 1 and given(b, y) - given(b, x) > 1


def test_rows_keep_their_scores_when_the_files_are_packed_anew(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}" for _ in range(k % 9 + 1))) for k in range(60)], "doc_id long, text string")
    docs.repartition(6).write.parquet(f"{tmp_path}/docs")
    real, n = lm.saved, spark.conf.get("spark.sql.files.maxPartitionBytes")

    def repacked(df, kind="table"):
        out = real(df, kind)
        if kind == "encoded":
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        return out

    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    monkeypatch.setattr(lm, "saved", repacked)
    try:
        got = lm.score_texts(spark.read.parquet(f"{tmp_path}/docs"), sample=5).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(k, k % 9 + 2) for k in range(60)]


def test_empty_tables(spark):
    docs = documents(spark)
    assert lm.op10_query(docs.limit(0)).count() == 0
    held = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    assert all(r.base_score == 0 and r.train_tokens == 0 for r in lm.op10_query(held).collect())


@pytest.mark.parametrize("most", [50, 1 << 16, 1 << 20])
def test_sums_by_key(most):
    g = np.random.default_rng(most)
    key, rows = g.integers(0, most, 400), g.normal(size=(400, 3))
    want = {k: (int((key == k).sum()), rows[key == k].sum(0)) for k in set(key.tolist())}
    got_key, n, sums = lm._sums(key, rows)
    assert got_key.tolist() == sorted(want) and n.tolist() == [want[k][0] for k in sorted(want)]
    assert np.allclose(sums, [want[k][1] for k in sorted(want)])
    assert all(len(x) == 0 for x in lm._sums(key[:0], rows[:0]))


def test_whole_texts_go_to_python_a_few_at_a_time(spark, monkeypatch):
    real, seen, name = lm.saved, [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(lm, "saved", lambda df, kind="table": seen.append(int(spark.conf.get(name))) or real(df, kind))
    out = lm.op10_query(documents(spark).limit(5))
    assert len(seen) == 3 and max(seen) <= 1000 and spark.conf.get(name) == before
    assert out.count() == 5
    # The returned plan has no Python left, which would run with the session's batches.
    assert "InArrow" not in out._jdf.queryExecution().executedPlan().toString()


def test_totals_add_up_counts():
    key, n = lm._totals([np.array([5, 9]), np.array([2, 9])], [np.array([1, 2]), np.array([3, 4])])
    assert key.tolist() == [2, 5, 9] and n.tolist() == [3, 1, 6]
    assert [len(x) for x in lm._totals([], [])] == [0, 0]
