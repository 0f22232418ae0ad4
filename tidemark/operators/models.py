"""Learned blend: features, logistic fit, walk-forward comparison with baselines."""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import accuracy as acc
from tidemark.session import stable

MODEL_VERSION = 1
FEATURES = [
    "algo", "news", "llm_context", "return_1m", "overext_elevated", "overext_extreme", "regime_neutral",
    "regime_risk_off", "market_kr", "tf_1m", "tf_6m",
]


def features(preds: DataFrame) -> DataFrame:
    """The eleven features from components, market and timeframe; anything malformed is 0.0."""
    v = F.try_parse_json("components")

    def num(k: str) -> Column:
        x = F.try_variant_get(v, f"$.{k}", "variant")
        kind = F.regexp_extract(F.coalesce(F.schema_of_variant(x), F.lit("")), "^([A-Z]+)", 1)
        ok = kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
        return F.coalesce(F.when(ok, F.try_variant_get(x, "$", "double")), F.lit(0.0))

    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    cols = {
        "algo": num("algo"), "news": num("news"), "llm_context": num("llm_context"), "return_1m": num("return_1m"),
        "overext_elevated": flag(text("overextension") == "ELEVATED"), "overext_extreme": flag(text("overextension") == "EXTREME"),
        "regime_neutral": flag(text("regime") == "NEUTRAL"), "regime_risk_off": flag(text("regime") == "RISK_OFF"),
        "market_kr": flag(F.col("market") == "KR"), "tf_1m": flag(F.col("timeframe") == "1M"), "tf_6m": flag(F.col("timeframe") == "6M"),
    }
    return preds.withColumns(cols)


def training_rows(preds: DataFrame) -> DataFrame:
    """Closed rows whose components carry an algo pillar, with label y and raw confidence."""
    has = F.try_variant_get(F.try_parse_json("components"), "$.algo", "variant").isNotNull()
    rows = features(acc.closed(preds).where(has))
    raw = F.coalesce(F.nullif(F.coalesce("raw_confidence", "confidence"), F.lit(0.0)), F.lit(0.5))
    return rows.select(
        "id", "created_at", "outcome_date", *FEATURES, (F.col("status") == "HIT").cast("double").alias("y"), raw.alias("raw_conf")
    )


def logistic(l2: float = 0.05, max_iter: int = 200) -> Pipeline:
    """Ridge logistic regression on standardised features, bias free."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=FEATURES, outputCol="_x"),
            StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True),
            LogisticRegression(
                featuresCol="_z", labelCol="y", regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=max_iter,
                tol=1e-9, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred",
            ),
        ]
    )


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p_blend", vector_to_array("_prob")[1]).drop("_x", "_z", "_raw", "_prob", "_pred")


def first_order(train: DataFrame, l2: float = 0.05) -> DataFrame:
    """Per feature (and 'bias') of a fit on `train`: mean of score times standardised feature, plus the penalty's pull.

    At the optimum these equal the same means of the labels.
    """
    model = logistic(l2).fit(train)
    weight = model.stages[-1].coefficients.toArray()
    rows = model.transform(train).select(vector_to_array("_prob")[1].alias("p"), vector_to_array("_z").alias("z"))
    parts = [F.struct(F.lit("bias").alias("feature"), F.avg("p").alias("moment"))]
    parts += [F.struct(F.lit(f).alias("feature"), (F.avg(F.col("p") * F.col("z")[i]) + l2 * float(weight[i])).alias("moment")) for i, f in enumerate(FEATURES)]
    return rows.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def isotonic_baseline(train: DataFrame, buckets: int = 5) -> DataFrame:
    """One-row anchors: equal-width buckets of training confidence, centres as x, monotone hit rate."""
    lo, hi = train.agg(F.min("raw_conf")).scalar(), train.agg(F.max("raw_conf")).scalar()
    span = F.coalesce(F.nullif(hi - lo, F.lit(0.0)), F.lit(1.0))
    k = F.least(F.floor((F.col("raw_conf") - lo) / span * buckets), F.lit(buckets - 1))
    g = train.groupBy(k.alias("k")).agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    g = g.select((lo + (F.col("k") + 0.5) * span / buckets).alias("x"), "y", "w")
    pts = F.array_sort(F.collect_list(F.struct("x", "y", "w")))
    return g.agg(pts.alias("p")).select(stats.isotonic_fit(F.col("p")).alias("anchors"))


class FoldFit(NamedTuple):
    """A fold's blend: score = sigmoid(weights . ((x - mean) / scale) + bias); a constant feature counts as 0."""

    n: int
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) * self.scale, np.ones(len(x))])

    def column(self) -> Column:
        terms = [(F.col(f) - float(m)) * float(k * w) for f, m, k, w in zip(FEATURES, self.mean, self.scale, self.weights, strict=False)]
        return 1 / (1 + F.exp(-sum(terms, F.lit(float(self.weights[-1])))))


def fold_training(rows: DataFrame, starts: dict) -> DataFrame:
    """Rows of `walk_forward_folds` once per fold that may learn from them: known before its first test row was made."""
    open_to = [F.when((F.col("outcome_date") < F.lit(t)) & (F.coalesce("fold", F.lit(-1)) < k), F.lit(k)) for k, t in sorted(starts.items())]
    return rows.withColumn("_f", F.explode(F.array_compact(F.array(*open_to)))).drop("fold").withColumnRenamed("_f", "fold")


def fit_folds(train: DataFrame, l2: float = 0.05, min_train: int = 50, tol: float = 1e-10, max_steps: int = 50) -> dict[int, FoldFit]:
    """Ridge logistic fits of all folds together: each Newton step is one job whose sums are grouped by fold.

    `train` has fold, the features and y. Folds of fewer than `min_train` rows or of one class have no fit. The driver
    sees a gradient and a Hessian a fold and step. Raises where a fold does not converge.
    """
    stats = train.groupBy("fold").agg(
        F.count("*"), F.count_distinct("y"), *[F.avg(f) for f in FEATURES], *[F.coalesce(F.stddev_samp(f), F.lit(0.0)) for f in FEATURES]).collect()
    d, fits = len(FEATURES), {}
    for r in stats:
        if r[1] >= min_train and r[2] > 1:
            dev = np.array(r[3 + d:], float)
            fits[r.fold] = FoldFit(r[1], np.array(r[3:3 + d], float), np.where(dev > 0, 1 / np.where(dev > 0, dev, 1), 0.0), np.zeros(d + 1))
    ridge = np.diag([l2] * d + [0.0])
    open_folds = set(fits)
    for _ in range(max_steps):
        if not open_folds:
            return fits
        now = {k: fits[k] for k in open_folds}

        def part(batches, now=now):
            sums = {}
            for b in batches:
                for k, one in b.groupby("fold"):
                    if k in now:
                        z, y = now[k].scaled(one[FEATURES].to_numpy()), one["y"].to_numpy()
                        p = 1 / (1 + np.exp(-z @ now[k].weights))
                        sums[k] = sums.get(k, 0.0) + np.concatenate([z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
            yield pd.DataFrame([(k, i, v) for k, s in sums.items() for i, v in enumerate(s)], columns=["fold", "i", "v"])

        parts = train.select("fold", "y", *FEATURES).mapInPandas(part, "fold int, i int, v double")
        got = parts.groupBy("fold", "i").agg(F.sum("v").alias("v")).toPandas()
        for k, one in got.groupby("fold"):
            v, fit = one.sort_values("i")["v"].to_numpy() / fits[k].n, fits[k]
            # a constant feature has no curvature of its own; the penalty keeps the system regular
            step = np.linalg.solve(v[d + 1:].reshape(d + 1, d + 1) + ridge, v[:d + 1] + ridge @ fit.weights)
            fits[k] = fit._replace(weights=fit.weights - step)
            if np.abs(step).max() < tol:
                open_folds.discard(k)
    if open_folds:
        raise RuntimeError(f"folds {sorted(open_folds)} did not converge")
    return fits


def _folds(preds: DataFrame, min_rows: int, folds: int, min_train: int) -> tuple[DataFrame, DataFrame, dict[int, FoldFit]]:
    """Rows with their fold, training rows of every fold, and the folds' fits."""
    rows = stable(acc.walk_forward_folds(training_rows(preds), folds, min_train))
    n = rows.count()
    if n < min_rows:
        raise ValueError(f"{n} rows, {min_rows} needed")
    starts = {r.fold: r.t for r in rows.where("fold IS NOT NULL").groupBy("fold").agg(F.min("created_at").alias("t")).collect()}
    if not starts:
        raise ValueError("no usable fold")
    train = stable(fold_training(rows, starts))
    fits = fit_folds(train, min_train=min_train)
    if not fits:
        raise ValueError("no usable fold")
    return rows, train, fits


def fold_scores(preds: DataFrame, min_rows: int = 100, folds: int = 3, min_train: int = 50) -> DataFrame:
    """fold, n_train, y and the three scores of every test row of a fold that could be fitted."""
    rows, train, fits = _folds(preds, min_rows, folds, min_train)
    scored = None
    for k, fit in sorted(fits.items()):
        # a handful of anchors per fold: one per confidence bucket
        fitted = isotonic_baseline(train.where(F.col("fold") == k)).first().anchors
        anchors = F.array(*[F.struct(F.lit(a.x).alias("x"), F.lit(a.y).alias("y")) for a in fitted])
        part = rows.where(F.col("fold") == k).select(
            "fold", F.lit(fit.n).alias("n_train"), "y", fit.column().alias("p_blend"), stats.interpolate(F.col("raw_conf"), anchors).alias("p_isotonic"), F.col("raw_conf").alias("p_raw"))
        scored = part if scored is None else scored.unionByName(part)
    return stable(scored)


METHODS = ("blend", "isotonic", "raw")


def evaluate(preds: DataFrame, min_rows: int = 100, folds: int = 3, min_train: int = 50) -> DataFrame:
    """Walk-forward comparison of the blend with isotonic and raw confidence over all test rows, one row per method.

    Folds follow created_at; a fold trains only on outcomes known before its first test row was made.
    """
    scored, out = fold_scores(preds, min_rows, folds, min_train), None
    for m in METHODS:
        one = acc.brier_auc(scored, f"p_{m}", "y").withColumn("method", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def fold_means(scored: DataFrame) -> DataFrame:
    """One row per method: folds, and the mean over folds of its Brier score and AUC (folds of one class have no AUC)."""
    out = None
    for k in sorted(r.fold for r in scored.select("fold").distinct().collect()):
        for m in METHODS:
            one = acc.brier_auc(scored.where(F.col("fold") == k), f"p_{m}", "y").withColumn("method", F.lit(m))
            out = one if out is None else out.unionByName(one)
    return out.groupBy("method").agg(F.count("*").alias("folds"), F.avg("brier").alias("brier"), F.avg("auc").alias("auc"))


def fold_first_order(preds: DataFrame, min_rows: int = 100, folds: int = 3, min_train: int = 50, l2: float = 0.05) -> DataFrame:
    """Per fold and feature (and 'bias'): training rows, and the score's moment plus the penalty's pull, as in `first_order`."""
    _, train, fits = _folds(preds, min_rows, folds, min_train)
    out = None
    for k, fit in sorted(fits.items()):
        p = fit.column()
        parts = [F.struct(F.lit("bias").alias("feature"), F.avg(p).alias("moment"))]
        for i, f in enumerate(FEATURES):
            z = (F.col(f) - float(fit.mean[i])) * float(fit.scale[i])
            parts.append(F.struct(F.lit(f).alias("feature"), (F.avg(p * z) + l2 * float(fit.weights[i])).alias("moment")))
        one = train.where(F.col("fold") == k).agg(F.array(*parts).alias("a")).select(F.lit(k).alias("fold"), F.lit(fit.n).alias("n_train"), F.inline("a"))
        out = one if out is None else out.unionByName(one)
    return out


def blend_wins(result: DataFrame, min_auc: float = 0.55) -> DataFrame:
    """The blend wins when its Brier is below the isotonic one and its AUC above the bar."""
    b = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    return result.agg(((b("blend", "brier") < b("isotonic", "brier")) & (b("blend", "auc") > min_auc)).alias("wins"))


def train_full(preds: DataFrame) -> PipelineModel:
    return logistic().fit(training_rows(preds))


def save_model(model: PipelineModel, spark: SparkSession, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    meta = json.dumps({"version": MODEL_VERSION, "features": FEATURES})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    """Load after checking version and feature names."""
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    if meta != {"version": MODEL_VERSION, "features": FEATURES}:
        raise ValueError(f"model metadata does not match: {meta}")
    return PipelineModel.load(f"{path}/model")
