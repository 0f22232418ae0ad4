"""Long-term accumulation scorecard: technical and macro sub-scores, verdict, report history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import windows as fw
from tidemark.operators import series

GRAMS_PER_OZ = 31.1035

# Default factor configuration.
DEFAULTS = {
    "trailing_4q_tonnes": 950.0, "baseline_tonnes": 500.0, "supportive_below_pct": 1.0, "restrictive_above_pct": 2.0,
    "punitive_above_pct": 3.5, "reserve_share_pct": 58.0, "assumed_pct": 1.9, "w_central_bank": 0.35, "w_real_rate": 0.30,
    "w_dollar": 0.20, "w_fx": 0.15,
}


def bands(value: Column, steps: list[tuple[str, float, float]], default: float) -> Column:
    """First matching (comparison, bound, score) step."""
    ops = {">": value.__gt__, ">=": value.__ge__, "<": value.__lt__, "<=": value.__le__}
    out = None
    for op, bound, score in steps:
        out = F.when(ops[op](bound), score) if out is None else out.when(ops[op](bound), score)
    return out.otherwise(default)


def technical(bars: DataFrame, keys=("ticker",)) -> DataFrame:
    """Trend, pullback and momentum sub-scores at every bar; applies to any series."""
    w = fw.series_window(keys)
    c = F.col("close")
    b = series.rsi_simple(bars, keys)
    high = F.max(c).over(w.rowsBetween(-251, 0))
    b = b.withColumns({"ma50": fw.price_mean(c, w, 50), "ma200": fw.price_mean(c, w, 200), "drawdown_pct": F.when(high != 0, (c / high - 1) * 100).otherwise(0.0)})
    b = b.withColumn("ma200_rising", F.coalesce(F.col("ma200") > F.lag("ma200", 20).over(w), F.lit(False)))
    trend = (
        F.when(F.col("ma200").isNotNull(), F.when((c >= F.col("ma200")) & F.col("ma200_rising"), 100.0).when(c >= F.col("ma200"), 60.0).otherwise(30.0))
        .when(c >= F.col("ma50"), 60.0).otherwise(30.0)
    )
    pull = bands(F.col("drawdown_pct"), [(">", -5, 40.0), (">", -20, 100.0), (">", -35, 70.0)], 30.0)
    mom = bands(F.col("rsi"), [("<", 30, 100.0), ("<", 45, 80.0), ("<", 60, 60.0), ("<=", 70, 40.0)], 15.0)
    b = b.withColumns({"trend": trend, "pullback": pull, "momentum": mom})
    return b.withColumn("technical_score", 0.40 * F.col("trend") + 0.30 * F.col("pullback") + 0.30 * F.col("momentum"))


def macro(factors: DataFrame) -> DataFrame:
    """Four factor sub-scores and their weighted total; every config field is a column."""
    c = F.col
    cb = F.when(c("trailing_4q_tonnes") >= 900, 100.0).when(c("trailing_4q_tonnes") >= 650, 70.0).when(c("trailing_4q_tonnes") >= c("baseline_tonnes"), 50.0).otherwise(30.0)
    y = c("real_yield_pct")
    rr = F.when(y <= c("supportive_below_pct"), 100.0).when((y >= c("punitive_above_pct")) | (y >= c("restrictive_above_pct")), 25.0).otherwise(60.0)
    pun = F.coalesce((y > c("supportive_below_pct")) & (y >= c("punitive_above_pct")), F.lit(False))
    dl = bands(c("reserve_share_pct"), [("<", 55, 70.0), ("<=", 60, 55.0)], 40.0)
    gap = (c("fx") / c("fx_ma200") - 1) * 100
    fx = F.when(gap > 5, 30.0).when(gap >= -5, 60.0).otherwise(80.0)
    d = factors.withColumns({"central_bank": cb, "real_rate": rr, "dollar": dl, "fx_score": fx, "punitive": pun})
    total = c("w_central_bank") * c("central_bank") + c("w_real_rate") * c("real_rate") + c("w_dollar") * c("dollar") + c("w_fx") * c("fx_score")
    return d.withColumn("macro_score", total)


def verdict(rsi: Column, technical_score: Column, macro_score: Column, punitive: Column, risk_off: Column) -> Column:
    return (
        F.when((rsi > 75) | punitive | risk_off, "PAUSE")
        .when((macro_score >= 55) & (technical_score >= 50), "ACCUMULATE").otherwise("HOLD")
    )


def merge_config(overrides: DataFrame, defaults: dict = DEFAULTS) -> DataFrame:
    """Override values win field by field; missing ones take the default."""
    have = set(overrides.columns)
    return overrides.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v) for k, v in defaults.items()})


def levels(closes: DataFrame, keys=("ticker",), min_rows: int = 5) -> DataFrame:
    """Last value, 200-row mean (all rows when short) and 3M/6M returns per series."""
    ok = closes.where("close > 0")
    w = fw.series_window(keys)
    c = F.col("close")
    d = ok.withColumns(
        {
            "n": F.row_number().over(w),
            "ma200": F.coalesce(fw.sma(c, w, 200), F.avg(c).over(w.rowsBetween(Window.unboundedPreceding, 0))),
            "ret_3m": F.when(F.row_number().over(w) > 63, (c / F.lag(c, 62).over(w) - 1) * 100),
            "ret_6m": F.when(F.row_number().over(w) > 126, (c / F.lag(c, 125).over(w) - 1) * 100),
        }
    )
    return series.last_rows(d, keys).where(F.col("n") >= min_rows)


def last_numeric(rows: DataFrame, assumed: Column) -> DataFrame:
    """Newest numeric value of a two-column series ('.' and blank are missing), else the assumed one."""
    v = F.when(~F.trim("value").isin(".", ""), F.col("value").try_cast("double"))
    g = rows.withColumn("_v", v).groupBy("series").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("date"))).alias("_v"))
    return g.select("series", F.coalesce("_v", assumed).alias("value"), F.col("_v").isNull().alias("estimated"))


def position_value(grams: Column, cost: Column, usd_per_oz: Column, fx: Column) -> dict[str, Column]:
    per_g = usd_per_oz * fx / GRAMS_PER_OZ
    return {"krw_per_g": per_g, "pnl_pct": F.when(cost != 0, (per_g / cost - 1) * 100), "value_krw": per_g * grams}


def week_deltas(reports: DataFrame, keys=("ticker",)) -> DataFrame:
    w = fw.series_window(keys, "report_date")
    d = lambda c: F.bround(F.col(c) - F.lag(c, 1).over(w), 0).cast("int")
    return reports.withColumns({"d_macro": d("macro_score"), "d_technical": d("technical_score")})


def context(tech: DataFrame, usd: DataFrame, fx: DataFrame, keys=("ticker",)) -> DataFrame:
    """Return decomposition, distance from the 200-bar mean and a note per missing feed."""
    j = tech.join(usd.select(*keys, F.col("ret_3m").alias("usd_ret_3m")), list(keys), "left").join(
        fx.select(*keys, F.col("last").alias("fx_last")), list(keys), "left"
    )
    both = F.col("usd_ret_3m").isNotNull() & F.col("ret_3m").isNotNull()
    notes = F.array_compact(
        F.array(
            F.when(F.col("usd_ret_3m").isNull(), "gold feed missing: no decomposition"),
            F.when(F.col("fx_last").isNull(), "fx feed missing: factor neutral"),
        )
    )
    gap = F.coalesce(F.when(F.col("ma200") != 0, (F.col("close") / F.col("ma200") - 1) * 100), F.lit(0.0))
    return j.withColumns(
        {
            "decomp_usd": F.when(both, F.col("usd_ret_3m")), "decomp_krw": F.when(both, F.col("ret_3m")),
            "ma200_gap_pct": gap, "fx_used": F.coalesce("fx_last", F.lit(1.0)), "notes": notes,
        }
    )
