"""Market regime and sector rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import rules
from tidemark.operators import series


def regime(metrics: DataFrame) -> DataFrame:
    """Risk-off points per component, score, label and notes for each index proxy row."""
    c = F.col
    pts = rules.regime_points(c("close"), c("ma50"), c("ma200"), c("pct_from_52w_high"), c("return_1m"), c("realized_vol"))
    out = metrics.withColumns({f"pts_{k}": v for k, v in pts.items()})
    score = sum((c(f"pts_{k}") for k in pts), F.lit(0))
    label = rules.regime_label(score, c("ma200"))
    pct = lambda x: F.concat(F.round(x * 100, 1).cast("string"), F.lit("%"))
    notes = F.array_compact(
        F.array(
            F.when(c("pts_trend") == 2, "price below MA200").when(c("pts_trend") == 1, "price below MA50"),
            F.when(c("pts_drawdown") > 0, F.concat(pct(c("pct_from_52w_high")), F.lit(" from 52w high"))),
            F.when(c("pts_momentum") > 0, F.concat(F.lit("1M return "), pct(c("return_1m")))),
            F.when(c("pts_volatility") > 0, F.concat(F.lit("realized vol "), pct(c("realized_vol")))),
            F.when(c("ma200").isNull() & (score < 2), "insufficient history, floored to NEUTRAL"),
        )
    )
    components = F.create_map(*[x for k in pts for x in (F.lit(k), c(f"pts_{k}"))])
    return out.withColumns({"score": score, "label": label, "notes": notes, "components": components})


def aggregate_regime(verdicts: DataFrame, keys: list[str], expected: DataFrame | None = None) -> DataFrame:
    """Worst proxy per key by severity, then score; first proxy on ties.

    `expected` lists the proxies a key should have; a missing one floors RISK_ON to NEUTRAL.
    """
    pick = F.struct(rules.severity(F.col("label")).alias("sev"), F.col("score"), (-F.col("ord")).alias("neg"))
    g = verdicts.groupBy(*keys).agg(
        F.max_by(F.struct("proxy", "label", "score"), pick).alias("w"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("proxy", "score")))).alias("proxy_scores"),
    )
    out = g.select(*keys, "w.*", "proxy_scores")
    if expected is None:
        return out
    lost = expected.join(verdicts, [*keys, "proxy"], "left_anti").groupBy(*keys).agg(
        F.array_sort(F.collect_set("proxy")).alias("missing")
    )
    out = out.join(lost, keys, "left")
    floor = (F.col("label") == "RISK_ON") & F.col("missing").isNotNull()
    return out.withColumn("label", F.when(floor, "NEUTRAL").otherwise(F.col("label")))


def breadth(metrics: DataFrame, members: DataFrame, bench: DataFrame, keys: list[str]) -> DataFrame:
    """Share of constituents above their 20-bar mean and ahead of the benchmark's month."""
    b = bench.select("market", F.col("return_1m").alias("_b1m"))
    m = metrics.join(members, "ticker").join(b, "market")
    valid = F.col("ma20").isNotNull() & F.col("return_1m").isNotNull() & F.col("_b1m").isNotNull()
    leads = (F.col("close") > F.col("ma20")) & (F.col("return_1m") > F.col("_b1m"))
    return m.groupBy(*keys).agg(F.avg(F.when(valid, leads.cast("double"))).alias("breadth_pct"))


def sector_verdicts(sector_metrics: DataFrame, breadths: DataFrame, bench: DataFrame, sectors: DataFrame) -> DataFrame:
    """Verdict and score per (market, sector); no benchmark or no proxy fund floors to NEUTRAL 50."""
    keys = ["market", "sector"]
    b = bench.select("market", F.col("return_1m").alias("b1m"), F.col("return_3m").alias("b3m"), F.lit(True).alias("has_bench"))
    e = sector_metrics.select(
        *keys, "close", "ma50", "rsi14", "overextension_level", "return_1m", "return_3m", F.lit(True).alias("has_etf")
    )
    j = sectors.join(e, keys, "left").join(b, "market", "left").join(breadths, keys, "left")
    known = F.coalesce(F.col("has_etf") & F.col("has_bench"), F.lit(False))
    j = j.withColumns(
        {
            "rs_1m": F.when(known, F.col("return_1m") - F.col("b1m")),
            "rs_3m": F.when(known, F.col("return_3m") - F.col("b3m")),
            "breadth_pct": F.when(known, F.col("breadth_pct")),
        }
    )
    st = F.when(known, rules.stage(F.col("close"), F.col("ma50"), F.col("rsi14"), F.col("overextension_level"), F.col("rs_1m"))).otherwise("MID")
    j = j.withColumn("stage", st)
    v = F.when(known, rules.sector_verdict(F.col("rs_1m"), F.col("rs_3m"), F.col("breadth_pct"), F.col("stage"))).otherwise("NEUTRAL")
    s = F.when(known, rules.sector_score(F.col("rs_1m"), F.col("breadth_pct"), F.col("stage"))).otherwise(50.0)
    return j.select(*keys, "rs_1m", "rs_3m", "breadth_pct", "stage", v.alias("verdict"), s.alias("score"), sector_notes(known).alias("notes"))


def sector_notes(known: Column) -> Column:
    pct = lambda name: F.format_string("%+.1f%%", F.col(name) * 100)
    return F.when(
        known,
        F.array_compact(
            F.array(
                F.when(F.col("rs_1m").isNotNull(), F.concat(F.lit("RS_1m "), pct("rs_1m"))),
                F.when(F.col("rs_3m").isNotNull(), F.concat(F.lit("RS_3m "), pct("rs_3m"))),
                F.when(F.col("breadth_pct").isNotNull(), F.format_string("breadth %.0f%%", F.col("breadth_pct") * 100)),
            )
        ),
    ).otherwise(F.array(F.lit("no benchmark or proxy data, floored to NEUTRAL")))


def rank_sectors(verdicts: DataFrame) -> DataFrame:
    w = Window.partitionBy("market").orderBy(F.desc("score"), "sector")
    return verdicts.withColumn("rank", F.row_number().over(w))


def sector_rotation(bars: DataFrame, sector_bars: DataFrame, bench_bars: DataFrame, members: DataFrame, asof=None) -> DataFrame:
    """The whole chain: bars to ranked sector verdicts."""
    last = lambda b, keys: series.horizon_metrics(b, keys, asof)
    bench = last(bench_bars, ("market",))
    etf = last(sector_bars, ("market", "sector"))
    cons = last(bars, ("ticker",)).select("ticker", "market", "close", "ma20", "return_1m")
    br = breadth(cons, members, bench, ["market", "sector"])
    return rank_sectors(sector_verdicts(etf, br, bench, etf.select("market", "sector")))


def sector_lookup(verdicts: DataFrame, members: DataFrame, etfs: DataFrame) -> DataFrame:
    """Ticker to its sector's verdict; constituents and proxy funds; a later sector overwrites."""
    both = members.select("ticker", "market", "sector").unionByName(etfs.select("ticker", "market", "sector"))
    j = both.join(verdicts.select("market", "sector", "verdict", "stage"), ["market", "sector"])
    return j.groupBy("market", "ticker").agg(F.max_by(F.struct("sector", "verdict", "stage"), "sector").alias("_v")).select(
        "market", "ticker", "_v.*"
    )


def apply_sector_boost(candidates: DataFrame, lookup: DataFrame) -> DataFrame:
    l = lookup.select("market", "ticker", F.col("verdict").alias("sector_verdict"), F.col("stage").alias("sector_stage"))
    j = candidates.join(l, ["market", "ticker"], "left")
    return j.withColumn("multiplier", rules.screen_multiplier(F.col("sector_verdict"), F.col("sector_stage")))
