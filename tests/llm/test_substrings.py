"""Substring dedup against counts of all windows; the automaton against counts of all substrings."""

import random
import re
from collections import Counter

import pytest

from tests.conftest import SF
from tests.llm.cases import documents
from tidemark.llm import substrings as s

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window=35):
    seqs = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in seqs for i in range(len(w) - window + 1))
    for w in seqs:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        yield len(w), len(gone), s.digest(" ".join(x for k, x in enumerate(w) if k not in gone))


def planted(seed=1):
    g = random.Random(seed)
    some = lambda n: [f"v{g.randrange(900)}" for _ in range(n)]
    passages = [some(n) for n in (34, 35, 36, 60, 200)]
    out = []
    for k in range(60):
        body = some(g.randrange(5, 80))
        for p in g.sample(passages, g.randrange(3)):
            a = g.randrange(0, 20)
            body += p[a:] + some(g.randrange(4)) if k % 3 else p + some(2)
        out.append((4000 + k, " ".join(body), "en", "a"))
    return out + [(4100, "same " * 80, "en", "a"), (4101, "one two three " * 30, "en", "a"), (4102, " ".join(some(35)), "en", "a")]


@pytest.mark.parametrize("hot", [s.HOT, 3])
def test_removed_words_match_counts_of_all_windows(spark, hot):
    docs = documents(spark, SF, planted())
    rows = docs.collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(rows, brute([r.text for r in rows]), strict=True))
    out = s.drop_repeats(docs, hot=hot).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, s.digest(r.kept)) for r in out) == want
    for r in out:
        assert r.n_removed == sum(int(z) - int(a) + 1 for a, z in (x.split("-") for x in r.spans.split(",") if x))


def test_rows_keep_their_numbers_when_the_files_are_packed_anew(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(k, " ".join(f"w{k % 40}x{i}" for i in range(35 + k)) + f" end{k}") for k in range(60)], "doc_id long, text string")
    docs.repartition(6).write.parquet(f"{tmp_path}/docs")
    real, names = s.saved, ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def repacked(df, kind="table"):
        out = real(df, kind)
        if kind == "runs":
            for n in names:
                spark.conf.set(n, "2k")
        return out

    monkeypatch.setattr(s, "saved", repacked)
    rows = docs.collect()
    try:
        out = s.drop_repeats(spark.read.parquet(f"{tmp_path}/docs")).collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    want = sorted((r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows]), strict=True))
    assert sorted((r.doc_id, r.n_words, r.n_removed, s.digest(r.kept)) for r in out) == want


def test_query_columns_and_empty_table(spark):
    docs = documents(spark)
    assert s.op7_query(docs).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert s.op7_query(docs.limit(0)).count() == 0


def test_automaton_counts_every_substring():
    g = random.Random(2)
    seqs = [[g.choice("ab") for _ in range(g.randrange(1, 14))] for _ in range(8)]
    seqs += seqs[:2]
    sam = s.SuffixAutomaton()
    for q in seqs:
        sam.add(q, 2)
    sam.finish()
    for n in (1, 2, 3, 5, 8):
        seen = Counter(tuple(q[i:i + n]) for q in seqs for i in range(len(q) - n + 1))
        for q in [*seqs, [g.choice("abc") for _ in range(40)]]:
            assert list(sam.matches(q, n)) == [2 * seen[tuple(q[i:i + n])] for i in range(len(q) - n + 1)]


def test_ids_of_any_type(spark):
    rows = [(i, f"w{i} " * 3 + "a b c d e f g " * 6) for i in range(4)]
    for kind in ("decimal(20,0)", "smallint", "binary"):
        docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr(f"cast(cast(doc_id as string) as {kind}) AS doc_id", "text")
        assert sorted(r.n_removed for r in s.drop_repeats(docs).collect()) == [42] * 4


def test_a_window_in_two_surroundings_is_removed_from_both(spark):
    shared = [f"s{i}" for i in range(40)]
    texts = [" ".join([*[f"{x}{i}" for i in range(3)], *shared, *[f"{x}z{i}" for i in range(3)]]) for x in ("a", "b")] + [" ".join(shared[:20])]
    out = s.drop_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_removed, r.spans) for r in out] == [(40, "3-42"), (40, "3-42"), (0, "")]
