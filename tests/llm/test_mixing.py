"""The mix against its contract: targets by plain reallocation, permutations, limits per document."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.cases import documents
from tidemark.llm import mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, out, free = share * sum(sizes.values()), {}, set(names)
    while True:
        part = {s: budget * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if part[s] > most * sizes[s]}
        if not over:
            return out | part
        for s in over:
            out[s] = most * sizes[s]
            budget -= out[s]
        free -= over
        if not free:
            return out


def test_mix_meets_its_contract(spark):
    docs = documents(spark, SF)
    rows = docs.collect()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    size = Counter()
    for r in rows:
        size[r.source] += len(word.findall(r.text or ""))
    want = targets(size)
    out = mixing.op3_query(docs).collect()
    assert len(out) == len(rows)
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(r.doc_id), len(word.findall(r.text or ""))) for r in rows)
    source = {r.doc_id: r.source for r in rows}
    taken = defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 64, s
    again = mixing.op3_query(docs.repartition(7)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_pieces_hold_every_word_once_and_shards_their_words(spark):
    docs = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    sizes = mixing.document_sizes(docs)
    pieces = mixing.pack(sizes, block=16)
    assert pieces.groupBy("doc_id").agg(F.sum("n").alias("n")).join(sizes, "doc_id").filter("n <> size").count() == 0
    full = pieces.groupBy("source", "block").agg(F.sum("n").alias("n"))
    assert full.filter("n > 16").count() == 0 and full.filter("n < 16").groupBy("source").count().filter("count > 1").count() == 0
    mixed, _ = mixing.mix(sizes, block=16)
    got = mixing.mixed_words(mixed, docs)
    assert got.filter(F.size("words") != F.col("n")).count() == 0 and got.count() > 0


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 10, 997):
        df = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n), F.lit(5)).alias("x"))
        assert sorted(r.x for r in df.collect()) == list(range(n))


def test_empty_tables(spark):
    assert mixing.op3_query(documents(spark).limit(0)).count() == 0
    nothing = mixing.op3_query(documents(spark).filter("text is null")).collect()
    assert [(r.size, r.taken, r.target) for r in nothing] == [(0, 0, 0.0)]


def test_slots_and_pieces_are_never_broadcast(spark):
    sizes = mixing.document_sizes(spark.range(400).selectExpr("id AS doc_id", "repeat('w ', 200) AS text", "cast(id % 3 AS string) AS source"))
    mixed, _ = mixing.mix(sizes)
    assert mixed.count() > 0
    mixed.collect()
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[rank#\d+L?, block#", plan) and not re.search(r"BroadcastHashJoin \[rank#\d+L?, block#", plan)


def test_slots_find_their_sources_in_a_guide_of_any_size(spark, monkeypatch):
    sizes = mixing.document_sizes(spark.range(60).selectExpr("id AS doc_id", "repeat('w ', 100) AS text", "cast(id % 7 AS string) AS source"))
    few = sorted(map(repr, mixing.mix(sizes)[0].collect()))
    monkeypatch.setattr(mixing, "GUIDED", 0)
    assert few and sorted(map(repr, mixing.mix(sizes)[0].collect())) == few
