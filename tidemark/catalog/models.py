"""Queries of the learned blend. An iterative fit has no SQL form; its first-order conditions have."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query, r6, rd, rd_sql
from tidemark.operators import models as ml
from tidemark.session import scalar

P = ("predictions",)
CL = "status IN ('HIT','MISS') AND components IS NOT NULL"


@query("fn_features", f"""SELECT id, CAST(json_extract(components, '$.algo') AS DOUBLE) AS algo, CAST(json_extract(components, '$.news') AS DOUBLE) AS news,
  CAST(json_extract_string(components, '$.overextension') = 'ELEVATED' AS INTEGER) AS elevated, CAST(json_extract_string(components, '$.overextension') = 'EXTREME' AS INTEGER) AS extreme,
  CAST(market = 'KR' AS INTEGER) AS kr, CAST(timeframe = '1M' AS INTEGER) AS tf_1m, CAST(status = 'HIT' AS DOUBLE) AS y FROM predictions WHERE {CL}""", P)
def fn_features(v):
    t = ml.training_rows(v.predictions)
    i = lambda c, n: F.col(c).cast("int").alias(n)
    return t.select("id", "algo", "news", i("overext_elevated", "elevated"), i("overext_extreme", "extreme"), i("market_kr", "kr"), i("tf_1m", "tf_1m"), "y")


@query("ml_logistic")
def ml_logistic(v):
    rows = ml.training_rows(v.predictions)
    return ml.score(ml.logistic().fit(rows), rows).select("id", "y", *r6("p_blend"))


@query("ml_evaluate")
def ml_evaluate(v):
    return ml.evaluate(v.predictions, folds=3, min_train=500).select("method", "n_pos", "n_neg", *r6("brier", "auc"))


@query("ml_fold_means")
def ml_fold_means(v):
    means = ml.fold_means(ml.fold_scores(v.predictions, folds=3, min_train=500))
    return means.select("method", "folds", *r6("brier", "auc"), scalar(ml.blend_wins(means)).alias("wins"))


VARYING = {
    "algo": "CAST(json_extract(components, '$.algo') AS DOUBLE)", "news": "CAST(json_extract(components, '$.news') AS DOUBLE)",
    "overext_elevated": "CAST(json_extract_string(components, '$.overextension') = 'ELEVATED' AS DOUBLE)",
    "overext_extreme": "CAST(json_extract_string(components, '$.overextension') = 'EXTREME' AS DOUBLE)",
    "market_kr": "CAST(market = 'KR' AS DOUBLE)", "tf_1m": "CAST(timeframe = '1M' AS DOUBLE)", "tf_6m": "CAST(timeframe = '6M' AS DOUBLE)",
}


@query("ml_first_order", f"t AS (SELECT CAST(status = 'HIT' AS DOUBLE) AS y, {', '.join(f'{x} AS {f}' for f, x in VARYING.items())} FROM predictions WHERE {CL}) "
       + " UNION ALL ".join(["SELECT 'bias' AS feature, round(avg(y), 4) AS moment FROM t"] + [
           f"SELECT '{f}', round((avg(y * {f}) - avg(y) * avg({f})) / stddev_samp({f}), 4) FROM t" for f in VARYING]), P)
def ml_first_order(v):
    """At the optimum of the penalised likelihood, the labels' moments are the scores' moments plus the penalty."""
    return ml.first_order(ml.training_rows(v.predictions)).where(F.col("feature").isin("bias", *VARYING)).select("feature", F.round("moment", 4).alias("moment"))


FOLDS = f"""t AS (SELECT id, created_at, outcome_date, CAST(status = 'HIT' AS DOUBLE) AS y, {', '.join(f'{x} AS {f}' for f, x in VARYING.items())},
  row_number() OVER (ORDER BY created_at, id) - 1 AS i, count(*) OVER () AS n FROM predictions WHERE {CL}),
f AS (SELECT *, CASE WHEN i >= 500 THEN least(floor((i - 500) / floor((n - 500) / 3)), 2)::INTEGER END AS fold FROM t),
s AS (SELECT fold AS k, min(created_at) AS start FROM f WHERE fold IS NOT NULL GROUP BY fold),
al AS (SELECT s.k, f.* FROM f JOIN s ON f.outcome_date < s.start AND coalesce(f.fold, -1) < s.k),
tr AS (SELECT * FROM al WHERE k IN (SELECT k FROM al GROUP BY k HAVING count(*) >= 500)) """


@query("ml_fold_first_order", FOLDS + " UNION ALL ".join(["SELECT k AS fold, count(*) AS n_train, 'bias' AS feature, round(avg(y), 4) AS moment FROM tr GROUP BY k"] + [
    f"SELECT k, count(*), '{f}', round((avg(y * {f}) - avg(y) * avg({f})) / nullif(stddev_samp({f}), 0), 4) FROM tr GROUP BY k" for f in VARYING]), P)
def ml_fold_first_order(v):
    """The folds' fits, all made in one pass a Newton step, at their optima: as ml_first_order, per fold."""
    t = ml.fold_first_order(v.predictions, folds=3, min_train=500)
    return t.where(F.col("feature").isin("bias", *VARYING)).select("fold", F.col("n_train").cast("long").alias("n_train"), "feature", F.round("moment", 4).alias("moment"))


@query("ml_train_persist", f"SELECT id, 1 AS same FROM predictions WHERE {CL}", P)
def ml_train_persist(v):
    import uuid

    from tidemark.session import checkpoint_root

    path = f"{checkpoint_root(v.spark)}/model-{uuid.uuid4().hex}"
    model, rows = ml.train_full(v.predictions), ml.training_rows(v.predictions)
    ml.save_model(model, v.spark, path)
    kept = ml.score(model, rows).select("id", F.col("p_blend").alias("p"))
    again = ml.score(ml.load_model(v.spark, path), rows).join(kept, "id")
    return again.select("id", (F.abs(F.col("p_blend") - F.col("p")) < 1e-12).cast("int").alias("same"))


@query("ml_isotonic_baseline", f"""
t AS (SELECT raw_confidence AS c, CASE WHEN status = 'HIT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM predictions WHERE {CL}),
b AS (SELECT min(c) AS lo, max(c) - min(c) AS sp FROM t),
k AS (SELECT least(floor((c - lo) / sp * 5), 4) AS k, y, lo, sp FROM t, b),
g AS (SELECT any_value(lo) + (k + 0.5::DOUBLE) * any_value(sp) / 5 AS x, avg(y) AS y, count(*) AS w FROM k GROUP BY k),
an AS (SELECT *, row_number() OVER (ORDER BY x) AS i FROM g),
seg AS (SELECT a.i AS j, b.i AS k, (SELECT sum(y * w) / sum(w) FROM an c WHERE c.i BETWEEN a.i AND b.i) AS m FROM an a JOIN an b ON a.i <= b.i),
lo AS (SELECT p.i, s.j, min(s.m) AS mn FROM an p JOIN seg s ON s.j <= p.i AND s.k >= p.i GROUP BY ALL)
SELECT {rd_sql('any_value(x)')} AS x, {rd_sql('max(mn)')} AS y FROM lo JOIN an USING (i) GROUP BY i""", P)
def ml_isotonic_baseline(v):
    a = ml.isotonic_baseline(ml.training_rows(v.predictions))
    return a.select(F.inline("anchors")).select(*rd("x", "y"))


