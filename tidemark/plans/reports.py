"""Composite reports: several operators over one predictions table, as one union of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import accuracy as acc


def signals_context(preds: DataFrame, asof, days: int = 30, top: int = 5, min_count: int = 5) -> DataFrame:
    """The briefing's accuracy block: a recent record, all-history calibration, best signals."""
    rec = acc.track_record(preds, [], with_streak=False, days=days, asof=asof).select(
        F.lit("record").alias("part"), F.lit(f"last{days}").alias("name"), F.col("total").alias("n"),
        F.round("win_rate", 6).alias("value"),
    )
    cal = acc.calibration(preds).select(
        F.lit("calibration").alias("part"), F.col("confidence_range").alias("name"),
        F.col("count").alias("n"), F.col("actual_accuracy").alias("value"),
    )
    best = acc.signal_performance(preds, min_count).orderBy(F.desc("win_rate"), "signal").limit(top)
    sig = best.select(
        F.lit("signal").alias("part"), F.col("signal").alias("name"), F.col("total").alias("n"),
        F.col("win_rate").alias("value"),
    )
    return rec.unionByName(cal).unionByName(sig)


def weekly_curves(preds: DataFrame, asof, windows=(7, 30, 90)) -> dict[str, DataFrame]:
    """Calibration per window of the raw and the logged confidence, with the buckets that are overconfident."""
    hm = acc.windows_explode(preds, asof, windows).where(F.col("status").isin("HIT", "MISS"))
    raw = acc.calibration(preds, ["days"], resolved=hm)
    logged = acc.calibration(preds, ["days"], use_raw=False, resolved=hm)
    return {
        "buckets": raw, "buckets_recal": logged,
        "overconfident_buckets": acc.overconfident_buckets(logged), "overconfident_buckets_raw": acc.overconfident_buckets(raw),
    }


def weekly_signals(preds: DataFrame, asof, windows=(7, 30, 90)) -> dict[str, DataFrame]:
    """Signals per window and the worst of them."""
    hm = acc.windows_explode(preds, asof, windows).where(F.col("status").isin("HIT", "MISS"))
    signals = acc.signal_performance(preds, 3, ["days"], resolved=hm)
    return {"signals": signals, "worst_signals": acc.worst_signals(signals)}


def weekly_report(preds: DataFrame, asof, windows=(7, 30, 90)) -> dict[str, DataFrame]:
    """Everything the weekly calibration report shows, each part windowed except decay."""
    rows = acc.windows_explode(preds, asof, windows)
    return {
        "track_record": rows.groupBy("days").agg(*acc._record_columns()),
        **weekly_curves(preds, asof, windows),
        **weekly_signals(preds, asof, windows),
        "decaying_signals": acc.decaying_signals(acc.signal_decay(preds, min_count=6)),
        "robustness": robustness(preds, asof, windows),
    }


def robustness(preds: DataFrame, asof, windows=(7, 30, 90), resamples: int = 1000) -> DataFrame:
    """Per window: the intervals of win rate and Brier score, and the permutation p-value of confidence."""
    parts = []
    for days in windows:
        rows, one = acc.closed(preds, days=days, asof=asof), F.lit(days).alias("days")
        ci = acc.bootstrap_ci(rows, resamples).select(one, "*")
        p = acc.permutation_test(rows, resamples).select(one, "observed_diff", "p_value")
        parts.append(ci.join(p, "days"))
    return reduce(DataFrame.unionByName, parts)
