"""Candidate screens: universe, momentum, pre-surge setups and their blend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import rules

MIN_BARS_MOMENTUM = 6
MIN_BARS_SETUP = 22


def top_universe(fundamentals: DataFrame, by_cap: int = 200, by_value: int = 50) -> DataFrame:
    """Largest by market cap, united with the most traded by value."""
    cap = fundamentals.orderBy(F.col("market_cap").desc_nulls_last(), "ticker").limit(by_cap)
    val = fundamentals.orderBy(F.col("trading_value").desc_nulls_last(), "ticker").limit(by_value)
    return cap.union(val).distinct()


def stale_tickers(universe: DataFrame, bars: DataFrame, min_bars: int = MIN_BARS_MOMENTUM) -> DataFrame:
    n = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_bars"))
    return universe.join(n, "ticker", "left").fillna(0, ["n_bars"]).where(F.col("n_bars") < min_bars)


def momentum_candidates(
    metrics: DataFrame, anchors: DataFrame | None = None, min_return: float = 15.0, min_volume: float = 2.0,
    top: int = 20,
) -> DataFrame:
    """Movers per market: anchors first (relabelled when also movers), then by absolute 5-day return.

    `metrics` is one row per ticker with ret5_pct and vol_ratio_prior.
    """
    moved = F.abs(F.col("ret5_pct")) >= min_return
    picks = metrics.where(
        (F.col("n_bars") >= MIN_BARS_MOMENTUM) & (moved | (F.col("vol_ratio_prior") >= min_volume))
    ).select(
        "market", "ticker", "ret5_pct", F.col("vol_ratio_prior").alias("vol_ratio"),
        F.when(moved, "momentum").otherwise("volume").alias("reason"), F.lit(None).cast("int").alias("anchor_ord"),
    )
    if anchors is not None:
        a = anchors.select("market", "ticker", F.col("ord").alias("_o"))
        full = picks.join(a, ["market", "ticker"], "full_outer")
        picks = full.select(
            "market", "ticker", F.coalesce("ret5_pct", F.lit(0.0)).alias("ret5_pct"),
            F.coalesce("vol_ratio", F.lit(1.0)).alias("vol_ratio"),
            F.when(F.col("_o").isNotNull(), "anchor").otherwise(F.col("reason")).alias("reason"),
            F.col("_o").alias("anchor_ord"),
        )
    w = Window.partitionBy("market").orderBy(
        F.col("anchor_ord").asc_nulls_last(), F.abs(F.col("ret5_pct")).desc(), "ticker"
    )
    return picks.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("anchor_ord")


def setup_scores(metrics: DataFrame) -> DataFrame:
    """Add `hits` (array of setups matched) and `best` (score, then fixed priority).

    Needs bench_1m, bench_6m and earnings_in_days columns; NULL disables that setup.
    """
    m = F.col
    score = {
        ("pullback", 4): rules.pullback(m),
        ("base_pivot", 3): rules.base_pivot(m),
        ("rs_leader", 2): rules.rs_leader(m, m("bench_1m"), m("bench_6m")),
        ("pre_earnings", 1): rules.pre_earnings(m, m("earnings_in_days")),
    }
    hits = F.filter(
        F.array(
            *[
                F.struct(s.alias("score"), F.lit(p).alias("priority"), F.lit(n).alias("setup"))
                for (n, p), s in score.items()
            ]
        ),
        lambda h: h["score"].isNotNull(),
    )
    ok = m("n_bars") >= MIN_BARS_SETUP
    return metrics.withColumn("hits", F.when(ok, hits)).withColumn("best", F.array_max("hits"))


def presurge_candidates(
    metrics: DataFrame, bench: DataFrame, earnings: DataFrame | None = None, min_score: float = 0.5,
    top: int | None = 20,
) -> DataFrame:
    """Best setup per ticker, ranked per market; `top` None keeps every ticker with a setup."""
    b = bench.select("market", F.col("return_1m").alias("bench_1m"), F.col("return_6m").alias("bench_6m"))
    m = metrics.join(b, "market", "left")
    if earnings is not None:
        # the earnings setup is for the US market only
        m = m.join(earnings.select("ticker", F.col("earnings_in_days").alias("_ed")), "ticker", "left")
        m = m.withColumn("earnings_in_days", F.when(F.col("market") == "US", F.col("_ed"))).drop("_ed")
    else:
        m = m.withColumn("earnings_in_days", F.lit(None).cast("int"))
    s = setup_scores(m).where(F.col("best.score") >= min_score)
    w = Window.partitionBy("market").orderBy(F.desc("best.score"), "ticker")
    s = s.withColumn("rank", F.row_number().over(w))
    if top is not None:
        s = s.where(F.col("rank") <= top)
    return s.select(
        "market", "ticker", F.col("best.setup").alias("setup"), F.col("best.score").alias("score"),
        (F.coalesce("return_1w", F.lit(0.0)) * 100).alias("ret5_pct"),
        F.coalesce("vol_ratio", F.lit(1.0)).alias("vol_ratio"), "rank",
    )


def blend_streams(momentum: DataFrame, presurge: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """One list per market: pre-surge before momentum, anchors apart, one row per ticker.

    With sector verdicts the order key is base * multiplier, stable within equal keys.
    """
    a = momentum.select(
        "market", "ticker", "reason", F.lit(None).cast("string").alias("setup"), "rank",
        F.when(F.col("reason") == "anchor", 0).otherwise(2).alias("stream"),
    )
    p = presurge.select("market", "ticker", F.lit("presurge").alias("reason"), "setup", "rank", F.lit(1).alias("stream"))
    first = Window.partitionBy("market", "ticker").orderBy("stream", "rank")
    u = a.unionByName(p).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    base = F.when(F.col("stream") == 1, 1.0).otherwise(0.5)
    if lookup is not None:
        l = lookup.select("market", "ticker", F.col("verdict").alias("sector_verdict"))
        u = u.join(l, ["market", "ticker"], "left")
        key = base * rules.funnel_multiplier(F.coalesce("sector_verdict", F.lit("NEUTRAL")))
    else:
        u = u.withColumn("sector_verdict", F.lit(None).cast("string"))
        key = base
    u = u.withColumns({"order_key": key, "role": F.when(F.col("stream") == 0, "anchor").otherwise("pick")})
    w = Window.partitionBy("market", "role").orderBy(F.desc("order_key"), "stream", "rank", "ticker")
    return u.withColumn("position", F.row_number().over(w)).select(
        "market", "role", "position", "ticker", "reason", "setup", "sector_verdict", "order_key"
    )
