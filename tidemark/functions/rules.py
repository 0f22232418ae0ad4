"""Threshold rules as columns. All cut-offs are keyword parameters with the published defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def overextension(
    rsi: Column, price: Column, ma20: Column,
    rsi_extreme=75.0, rsi_elevated=70.0, ma_extreme=0.15, ma_elevated=0.08,
) -> Column:
    """EXTREME, ELEVATED or NONE; strict comparisons, missing inputs do not fire."""
    gap = F.when(ma20 > 0, price / ma20 - 1)
    return (
        F.when(_yes(rsi > rsi_extreme) | _yes(gap > ma_extreme), "EXTREME")
        .when(_yes(rsi > rsi_elevated) | _yes(gap > ma_elevated), "ELEVATED")
        .otherwise("NONE")
    )


def cycle_risk(return_1y: Column, pct_high: Column, min_return=1.0, min_pct=-0.15) -> Column:
    return _yes((return_1y > min_return) & (pct_high > min_pct))


def step_points(value: Column, caution: float, severe: float, rising: bool = False) -> Column:
    """0, 1 or 2 risk points; a missing value scores 0."""
    hit = (lambda t: value >= t) if rising else (lambda t: value <= t)
    return F.when(hit(severe), 2).when(hit(caution), 1).otherwise(0)


def regime_points(
    price: Column, ma50: Column, ma200: Column, pct_high: Column, ret_1m: Column, vol: Column,
    drawdown=(-0.05, -0.10), momentum=(-0.03, -0.08), volatility=(0.20, 0.30),
) -> dict[str, Column]:
    return {
        "trend": F.when(price < ma200, 2).when(price < ma50, 1).otherwise(0),
        "drawdown": step_points(pct_high, *drawdown),
        "momentum": step_points(ret_1m, *momentum),
        "volatility": step_points(vol, *volatility, rising=True),
    }


def regime_label(score: Column, ma200: Column, risk_off=4, neutral=2) -> Column:
    """Without a 200-bar mean the trend anchor is unknown, so RISK_ON is not certified."""
    return (
        F.when(score >= risk_off, "RISK_OFF")
        .when((score >= neutral) | ma200.isNull(), "NEUTRAL")
        .otherwise("RISK_ON")
    )


def severity(label: Column) -> Column:
    return F.when(label == "RISK_OFF", 2).when(label == "NEUTRAL", 1).otherwise(0)


def stage(
    price: Column, ma50: Column, rsi: Column, level: Column, rs_1m: Column,
    late_above=0.15, late_rsi=70.0, band=0.08, early_rsi=(45.0, 65.0),
) -> Column:
    dist = F.when(ma50 > 0, price / ma50 - 1)
    late = level.isin("ELEVATED", "EXTREME") | _yes(dist > late_above) | _yes(rsi > late_rsi)
    early = _yes(rsi.between(*early_rsi)) & _yes(F.abs(dist) <= band) & (level == "NONE") & _yes(rs_1m > 0)
    return F.when(late, "LATE").when(early, "EARLY").otherwise("MID")


def sector_verdict(
    rs_1m: Column, rs_3m: Column, breadth: Column, stage_: Column, favor=0.5, avoid=0.4, weak=0.4
) -> Column:
    b = F.coalesce(breadth, F.lit(0.0))
    return (
        F.when(rs_1m.isNull(), "NEUTRAL")
        .when((rs_1m > 0) & (b >= favor) & stage_.isin("EARLY", "MID"), "FAVOR")
        .when((rs_1m > 0) & (rs_3m <= 0) & (stage_ == "EARLY"), "ROTATING_IN")
        .when((rs_1m < 0) & (rs_3m > 0), "ROTATING_OUT")
        .when((stage_ == "LATE") & (b < weak), "ROTATING_OUT")
        .when((rs_1m < 0) & (b < avoid), "AVOID")
        .otherwise("NEUTRAL")
    )


def sector_score(rs_1m: Column, breadth: Column, stage_: Column, clamp=0.10, weights=(0.5, 0.3, 0.2)) -> Column:
    rs = F.coalesce((F.greatest(F.lit(-clamp), F.least(F.lit(clamp), rs_1m)) + clamp) / (2 * clamp), F.lit(0.5))
    # least/greatest skip NULL, so the missing case is decided first
    rs = F.when(rs_1m.isNull(), 0.5).otherwise(rs)
    st = F.when(stage_ == "EARLY", 1.0).when(stage_ == "LATE", 0.2).otherwise(0.6)
    return F.round(100 * (weights[0] * rs + weights[1] * F.coalesce(breadth, F.lit(0.0)) + weights[2] * st), 1)


def screen_multiplier(verdict: Column, stage_: Column) -> Column:
    """Ranking multiplier of the momentum screen (uses the stage)."""
    v, s = F.upper(verdict), F.upper(stage_)
    return (
        F.when((v == "FAVOR") & (s == "EARLY"), 1.3)
        .when(v.isin("FAVOR", "ROTATING_IN"), 1.15)
        .when(v == "AVOID", 0.6)
        .when(v == "ROTATING_OUT", F.when(s == "LATE", 0.6).otherwise(0.8))
        .otherwise(1.0)
    )


def funnel_multiplier(verdict: Column) -> Column:
    """Ranking multiplier of the blended funnel (verdict only)."""
    return (
        F.when(verdict == "FAVOR", 1.3)
        .when(verdict == "ROTATING_IN", 1.15)
        .when(verdict == "ROTATING_OUT", 0.8)
        .when(verdict == "AVOID", 0.6)
        .otherwise(1.0)
    )


PARABOLIC_RETURN_1M = 0.20


def base_pivot(m) -> Column:
    """Volatility coil near the 20/50-bar means. `m` maps metric names to columns."""
    coil = F.abs(m("close") / m("ma20") - 1)
    ok = (
        (m("overextension_level") == "NONE")
        & m("rsi14").between(45.0, 65.0)
        & (m("return_1m").isNull() | (m("return_1m") < PARABOLIC_RETURN_1M))
        & (m("ma20") > 0) & (m("ma50") > 0)
        & (coil <= 0.05)
        & (F.abs(m("close") / m("ma50") - 1) <= 0.08)
        & (m("close") >= m("ma50") * 0.97)
        & (m("contraction") <= 0.75)
    )
    score = (
        0.4 * clamp01((0.75 - m("contraction")) / 0.75)
        + 0.3 * clamp01(1 - coil / 0.05)
        + 0.3 * m("volume_pattern")
    )
    return F.when(ok, F.round(score, 4))


def pullback(m) -> Column:
    """Dip into the 20/50-bar support zone of an intact uptrend."""
    ok = (
        (m("ma20") > m("ma50")) & (m("ma50") > m("ma200"))
        & (m("overextension_level") != "EXTREME")
        & (m("return_1m").isNull() | (m("return_1m") < PARABOLIC_RETURN_1M))
        & m("rsi14").between(40.0, 55.0)
        & (m("close") >= m("ma50") * 0.98) & (m("close") <= m("ma20") * 1.02)
    )
    dist = F.least(F.abs(m("close") / m("ma20") - 1), F.abs(m("close") / m("ma50") - 1))
    return F.when(ok, F.round(0.5 + 0.5 * clamp01(1 - dist / 0.05), 4))


def rs_leader(m, bench_1m: Column, bench_6m: Column) -> Column:
    """Beats its index by 5 points over a month and, when both are known, over six."""
    excess = m("return_1m") - bench_1m
    ok = (
        (m("overextension_level") != "EXTREME")
        & m("return_1m").between(0.05, 0.20)
        & (excess >= 0.05)
        & ~_yes(m("return_6m") <= bench_6m)
    )
    return F.when(ok, F.round(0.5 + 0.5 * clamp01(excess / 0.15), 4))


def pre_earnings(m, days: Column) -> Column:
    ok = (
        days.between(5, 10)
        & (m("overextension_level") != "EXTREME")
        & (m("return_1m") > 0) & (m("return_1m") < PARABOLIC_RETURN_1M)
        & (m("contraction") <= 0.85)
    )
    score = 0.5 + 0.3 * clamp01((0.85 - m("contraction")) / 0.85) + 0.2 * clamp01(m("return_1m") / PARABOLIC_RETURN_1M)
    return F.when(ok, F.round(F.least(score, F.lit(1.0)), 4))
