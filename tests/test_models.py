"""Fits of all folds together against single fits, and fold means against plain sums."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as ml


@pytest.fixture(scope="module")
def train(spark):
    g, rows = random.Random(3), []
    for fold, n in ((0, 80), (1, 300), (2, 20), (3, 90)):
        for _ in range(n):
            x = [g.gauss(0, 1) for _ in range(4)] + [float(g.random() < 0.3) for _ in range(6)] + [1.0]
            rows.append((fold, *x, 1.0 if fold == 3 else float(g.random() < 1 / (1 + np.exp(-x[0] + x[1])))))
    return spark.createDataFrame(rows, "fold int, " + ", ".join(f"{f} double" for f in ml.FEATURES) + ", y double").repartition(5)


def test_folds_fit_as_if_alone(train):
    fits = ml.fit_folds(train)
    assert sorted(fits) == [0, 1]  # too few rows, one class
    for k, fit in fits.items():
        one = train.where(F.col("fold") == k)
        got = ml.score(ml.logistic().fit(one), one.withColumn("p", fit.column())).agg(F.max(F.abs(F.col("p") - F.col("p_blend"))).alias("d")).first().d
        assert got < 1e-5 and fit.n == one.count()


def test_training_rows_are_known_before_the_fold(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, None, 9), (3, 0, 4), (4, 1, 6)], "id int, fold int, outcome_date int")
    got = {(r.fold, r.id) for r in ml.fold_training(rows, {0: 3, 1: 5}).collect()}
    assert got == {(0, 1), (1, 1), (1, 3)}


def test_fold_means_and_win(spark):
    g = random.Random(5)
    rows = [(k, float(g.random() < 0.5), g.random(), g.random(), 0.5) for k in (0, 1) for _ in range(40)]
    scored = spark.createDataFrame(rows, "fold int, y double, p_blend double, p_isotonic double, p_raw double")
    got = {r.method: r for r in ml.fold_means(scored).collect()}
    for i, m in enumerate(ml.METHODS):
        briers, aucs = [], []
        for k in (0, 1):
            own = [r for r in rows if r[0] == k]
            briers.append(np.mean([(r[2 + i] - r[1]) ** 2 for r in own]))
            aucs.append(np.mean([(a[2 + i] > b[2 + i]) + 0.5 * (a[2 + i] == b[2 + i]) for a in own if a[1] for b in own if not b[1]]))
        assert got[m].folds == 2 and abs(got[m].brier - np.mean(briers)) < 1e-9 and abs(got[m].auc - np.mean(aucs)) < 1e-9
    assert ml.blend_wins(ml.fold_means(scored)).first().wins == (got["blend"].brier < got["isotonic"].brier and got["blend"].auc > 0.55)
