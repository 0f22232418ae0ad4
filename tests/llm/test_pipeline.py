"""The pipeline stage by stage against plain decisions on the same rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm import test_jaccard
from tests.llm.cases import documents
from tidemark.llm import classifier, decontaminate, mixing

SF = "/root/testdata/sf0.001"
KEY = "9f3a61c0d5e24b7788aa01fe62cd934b5a7e0c11"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    more = [*test_jaccard.near_copies(12, 3, 4, 5000), (8000, f'some words with token = "{KEY}" in them', "en", "a")]
    docs = documents(spark, SF, more)
    out = [docs]
    folder = tmp_path_factory.mktemp("stages")
    for k, (_, f) in enumerate(p.STAGES):
        f(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:5])
    assert stages[5].columns[-4:] == ["size", "source_size", "target", "taken"]


def test_quality_stage_keeps_what_the_classifier_accepts(spark, stages):
    verdict = classifier.score_quality(stages[0], spark.read.parquet(f"{SF}/labels.parquet"), keep=("lang", "source")).filter("predicted = 1")
    assert sorted(map(repr, verdict.select("doc_id").collect())) == sorted(map(repr, stages[1].select("doc_id").collect()))
    assert set(rows(stages[1])) <= set(rows(stages[0]))


def test_one_of_each_group_stays(stages):
    given = stages[1].collect()
    comp = test_jaccard.brute(given, 5, 80)
    want = {c for _, n, c in comp if n} | set()
    kept = [r.doc_id for r in stages[2].collect()]
    full = [i for i in kept if i in want]
    assert set(full) == want and len(full) == len(want)
    assert len(kept) == len(want) + sum(n == 0 for _, n, _ in comp)


def test_leaks_go_and_others_stay(spark, stages):
    leaks = decontaminate.find_leaks(stages[2], spark.read.parquet(f"{SF}/benchmark.parquet"))
    gone = {r.doc_id for r in leaks.collect()}
    assert rows(stages[3]) == sorted((tuple(r) for r in stages[2].collect() if r.doc_id not in gone), key=repr)


def test_secrets_are_replaced_and_nothing_else(stages):
    plain = re.compile(r'(?i)token = "[0-9a-f]{40}"')
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[3:5])
    assert before.keys() == after.keys()
    for i, r in before.items():
        if plain.search(r.text or ""):
            assert not plain.search(after[i].text) and after[i].n_chars == len(after[i].text)
        elif after[i].text == r.text:
            assert after[i] == r


def test_mixture_covers_all_rows(stages):
    given, out = stages[4], stages[5]
    own = [c if c != "size" else "given_size" for c in given.columns]  # the fixture's clashing column
    assert rows(out.select(*own)) == rows(given)
    assert out.filter("taken > 2 * size or taken < 0").count() == 0
    want = {r.source: r.target for r in mixing.source_targets(mixing.document_sizes(given).groupBy("source").agg(F.sum("size").alias("source_size"))).collect()}
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect():
        assert abs(r.w - want[r.source]) < 1e-6 and abs(r.t - r.w) <= 64


def test_rows_keep_their_numbers_when_the_files_are_packed_anew(spark, monkeypatch, tmp_path):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    docs = spark.createDataFrame([(k, text(k % 40), "en", "a", 9) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(6).write.parquet(f"{tmp_path}/docs")
    real, names = p.link_components, ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def repacked(*a, **k):
        out = p.saved(real(*a, **k))
        for n in names:
            spark.conf.set(n, "2k")
        return out

    monkeypatch.setattr(p, "link_components", repacked)
    try:
        kept = [r.doc_id for r in p.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), SF).collect()]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert sorted(kept) == list(range(40))


def test_run_numbers_rows_once_and_drops_the_number(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(p, "STAGES", [(n, lambda *a, f=f: seen.append(p.ROW in a[1].columns) or f(*a)) for n, f in p.STAGES])
    assert p.ROW not in p.run(spark, SF).columns and seen == [False, True, True, True, True]


def test_empty_documents(spark):
    docs = documents(spark).limit(0)
    for _, f in p.STAGES:
        docs = f(spark, docs, SF)
        assert docs.count() == 0


def test_run_leaves_only_its_result_in_the_shared_folder(spark, monkeypatch, tmp_path):
    from tidemark.llm import common

    monkeypatch.setattr(common, "checkpoint_root", lambda _: f"{tmp_path}")
    assert p.run(spark, SF).count() > 0
    assert [f.name.rsplit("-", 1)[0] for f in tmp_path.iterdir() if not f.name.startswith(".")] == [p.STAGES[-1][0]]


def test_stages_leave_only_rows_and_verdicts_in_the_shared_folder(spark, monkeypatch, tmp_path, stages):
    from tidemark.llm import common

    monkeypatch.setattr(common, "checkpoint_root", lambda _: f"{tmp_path}")
    left = {}
    for k, verdict in ((1, "first"), (2, "leaks"), (4, "taken")):
        seen = set(tmp_path.iterdir())
        out = p.STAGES[k][1](spark, stages[k], SF)
        assert rows(out) == rows(stages[k + 1])
        left[verdict] = sorted(f.name.split("-")[0] for f in set(tmp_path.iterdir()) - seen)
    assert left == {k: sorted([k, "numbered"]) for k in left}


@pytest.mark.parametrize("cells", [1, 1 << 18])
def test_rows_that_the_filter_clears_are_not_joined(spark, monkeypatch, cells):
    from tidemark.llm import common

    monkeypatch.setattr(common, "FILTER_CELLS", cells)
    given = spark.range(5000).select(F.col("id").alias("k"), F.lit("some text").alias("a.b"))
    gone = given.filter("k % 7 = 3").select("k")
    joined = spark.sparkContext.accumulator(0)
    real = type(given).join

    def seen(self, other, on=None, how=None):
        if how == "left_anti":
            joined.add(self.count())
        return real(self, other, on, how)

    monkeypatch.setattr(type(given), "join", seen)
    out = common.without(given, gone, "k")
    assert out.columns == given.columns and sorted(r.k for r in out.collect()) == [k for k in range(5000) if k % 7 != 3]
    assert joined.value < 800 if cells > 1 else joined.value == 5000


def test_stages_join_rows_by_what_goes(spark, monkeypatch, stages):
    seen = []
    monkeypatch.setattr(p, "without", lambda rows, gone, key: (seen.append(gone.count()), rows.join(gone, key, "left_anti"))[1])
    for k in (1, 2):
        assert rows(p.STAGES[k][1](spark, stages[k], SF)) == rows(stages[k + 1])
    assert seen == [stages[k].count() - stages[k + 1].count() for k in (1, 2)] and seen[0] > 0
