"""Catalyst calendar: timeline and the event-risk gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates as fd
from tidemark.functions import fixed


def timing(raw: Column) -> Column:
    t = F.lower(raw)
    return (
        F.when(t.isin("bmo", "pre-market", "before market open"), "BMO")
        .when(t.isin("amc", "after-market", "after market close"), "AMC")
        .otherwise("TAS")
    )


def is_macro_event(name: Column, country: Column, impact: Column) -> Column:
    """High-impact US release whose name carries a market-moving keyword."""
    pattern = "|".join(k.replace("-", r"\-") for k in fixed.MACRO_KEYWORDS)
    return F.coalesce(
        F.lower(name).rlike(pattern) & F.lower(F.trim(country)).isin(*fixed.MACRO_COUNTRIES) & (impact == "High"),
        F.lit(False),
    )


def timeline(events: DataFrame, asof) -> DataFrame:
    """Events on or after `asof` with their distance in trading days; macro rows lose the ticker."""
    d = F.lit(asof).cast("date")
    ok = F.when(F.col("kind") == "macro", is_macro_event(F.col("name"), F.col("country"), F.col("impact"))).otherwise(
        F.col("ticker").isNotNull()
    )
    macro = F.col("kind") == "macro"
    return events.where((F.col("event_date") >= d) & ok).select(
        F.when(~macro, F.col("ticker")).alias("ticker"),
        F.when(macro, "GLOBAL").otherwise(F.col("market")).alias("market"),
        "kind", "name", "event_date", F.when(~macro, timing(F.col("time"))).alias("timing"),
        fd.business_days(d, F.col("event_date")).alias("trading_days_until"),
    )


def event_gate(
    tickers: DataFrame, events: DataFrame, asof, watch_days: int = 2, trim_days: int = 5, macro_days: int = 2,
    trim: float = 0.05, earnings_available: bool = True, macro_available: bool = True,
) -> DataFrame:
    """Per-ticker cap and confidence trim. With no feed at all the row says so instead of 'no risk'."""
    line = timeline(events, asof)
    near = line.where("kind = 'earnings'").groupBy("ticker").agg(
        F.min(F.struct("trading_days_until", "event_date")).alias("_e")
    )
    macro_hit = (
        line.where((F.col("kind") == "macro") & (F.col("trading_days_until") <= macro_days))
        .agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    )
    out = tickers.join(near, "ticker", "left")
    us = (F.col("market") == "US") & F.lit(earnings_available)
    td = F.when(us, F.col("_e.trading_days_until"))
    dead = (F.col("market") == "US") & F.lit(not earnings_available and not macro_available) | (
        (F.col("market") != "US") & F.lit(not macro_available)
    )
    return out.select(
        "ticker", "market",
        F.when(td <= watch_days, "WATCH").alias("cap_label"),
        F.when((td > watch_days) & (td <= trim_days), trim).otherwise(0.0).alias("confidence_trim"),
        F.when(us, F.col("_e.event_date")).alias("next_earnings_date"),
        td.alias("trading_days_until"),
        F.when(macro_hit & F.lit(macro_available) & ~dead, trim).otherwise(0.0).alias("macro_trim"),
        dead.alias("gate_unavailable"),
    )


def next_earnings(payload: DataFrame, asof) -> DataFrame:
    """Nearest date on or after `asof` per ticker from exploded payload rows.

    Zoned instants become New York dates. Tickers whose lookup failed are kept apart from those
    with no scheduled date.
    """
    d = F.coalesce(
        F.to_date(F.from_utc_timestamp("instant", "America/New_York")), F.col("plain_date")
    )
    day = F.lit(asof).cast("date")
    return payload.withColumn("_d", d).groupBy("ticker").agg(
        F.min(F.when(F.col("_d") >= day, F.col("_d"))).alias("next_date"),
        F.max(F.coalesce("failed", F.lit(False))).alias("lookup_failed"),
    )


def earnings_in_days(events: DataFrame, asof) -> DataFrame:
    """Calendar days to each ticker's nearest earnings on or after `asof`."""
    d = F.lit(asof).cast("date")
    e = events.where((F.col("kind") == "earnings") & (F.col("event_date") >= d))
    return e.groupBy("ticker").agg(F.min(F.datediff("event_date", d)).alias("earnings_in_days"))
