"""Quality classifier: held-out ranking, fixed contract columns, calibration, edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents
from tidemark.llm import classifier

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    docs = documents(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    return docs, labels, classifier.op5_query(docs, labels).collect()


def test_every_row_is_scored_and_split_by_crc(scored):
    docs, _, out = scored
    assert len(out) == docs.count()
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_held_out_documents_rank_right(scored):
    _, labels, out = scored
    score = {r.doc_id: r.score for r in out if r.held_out}
    by = {0: [], 1: []}
    for r in labels.collect():
        if r.doc_id in score:
            by[r.quality].append(score[r.doc_id])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in by[1] for b in by[0]])
    assert auc > 0.95 and np.mean(np.array(by[1]) >= 0.7) > 0.95


def test_held_out_labels_have_no_influence(spark, scored):
    docs, labels, out = scored
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {(r.doc_id, round(r.score, 6)) for r in classifier.op5_query(docs, flipped).collect()}
    assert again == {(r.doc_id, round(r.score, 6)) for r in out}


def test_no_labels_one_class_and_no_documents(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.op5_query(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(1, 10)] + [(4, None, 0)], "doc_id long, quality int, toxic int")
    assert min(r.score for r in classifier.op5_query(docs, one).collect()) > 0.9
    assert classifier.op5_query(docs.limit(0), one).count() == 0


def test_isotonic_pools():
    at, value = classifier.isotonic(np.array([0.0, 1, 2, 3]), np.ones(4), np.array([0.0, 1, 0, 1]))
    assert value.tolist() == [0, 0.5, 1] and at.tolist() == [0, 1.5, 3]


def test_features_approximate_the_kernel():
    g = np.random.default_rng(0)
    m = classifier.Model(np.zeros(4), np.ones(4), g.normal(size=(4, 8000)) / 2, g.uniform(0, 2 * np.pi, 8000), None, None, None)
    x = g.normal(size=(20, 4))
    z = m.features(x)[:, :-1]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-d / 8)).max() < 0.06
